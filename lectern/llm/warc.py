"""WARC archives: one gzip member a record, written and read back by tasks.

The writer gives a page a ``response`` record, or a ``revisit`` record that
refers to the page with an equal payload and the largest page_id.  The reader is
sequential: it inflates an archive a block at a time, frames each record by its
Content-Length and verifies both digests.  An archive is never held whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_dir, table

CRLF = b"\r\n"
READ = "archive string, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _store(path: str):
    """(file system, path on it) of a folder that tasks can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _line(value: str) -> bytes:
    """A header value on one line; what could end it is percent-encoded."""
    return "".join(c if c > " " and c not in "%\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value).encode("utf-8", "surrogatepass")


def _unline(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value)


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id)


def _page(urn: bytes | None) -> int | None:
    name = (urn or b"none").strip(b"<>").rsplit(b":", 1)[-1]
    return None if name == b"none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha: str, refers_to: int | None = None) -> bytes:
    """One record as a gzip member.  A revisit has the response's head, whose Content-Length tells the payload's size, and no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if refers_to is not None else head + payload
    fields = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + _urn(page_id),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: sha1:" + sha.encode(),
        b"WARC-Block-Digest: sha1:" + digest(block).encode(),
    ]
    if url is not None:
        fields.append(b"WARC-Target-URI: " + _line(url))
    if refers_to is not None:
        fields += [b"WARC-Refers-To: " + _urn(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    fields.append(b"Content-Length: %d" % len(block))
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(CRLF.join(fields) + CRLF * 2 + block + CRLF * 2) + press.flush()


def members(stream, size: int = 1 << 16):
    """For each gzip member of a stream, its inflated bytes as an iterator of pieces of ``size`` and less."""
    raw = b""

    def pieces(press):
        nonlocal raw
        while not press.eof:
            raw = raw or stream.read(size)
            out = press.decompress(raw, size)
            if not out and not raw:
                raise ValueError("the archive ends inside a member")
            raw = press.unconsumed_tail or press.unused_data
            if out:
                yield out

    while True:
        raw = raw or stream.read(size)
        if not raw:
            return
        own = pieces(zlib.decompressobj(31))
        yield own
        for _ in own:  # what the reader of the record left
            pass


def _head(held: bytes, pieces, most: int = 1 << 20) -> tuple[bytes, bytes]:
    """(bytes up to an empty line, what was read behind it); without an empty line the second is empty."""
    while (at := held.find(CRLF * 2)) < 0 and len(held) < most and (more := next(pieces, None)) is not None:
        held += more
    return (held, b"") if at < 0 else (held[:at], held[at + 4 :])


def _exactly(n: int, held: bytes, pieces, rest: list):
    """The next n bytes piece by piece; what was read behind them goes to ``rest``."""
    while n > 0 and (held or (held := next(pieces, b""))):
        yield held[:n]
        n, held = n - min(n, len(held)), held[n:]
    rest.append(held)


def frame(pieces, payloads: bool = True) -> dict:
    """Type, ids, payload and digests of one record, whose bytes come in pieces; ``intact`` tells if framing and digests agree.

    The record's Content-Length says where its block ends.  Both digests are taken
    piece by piece; no more than a piece is held, but for the payload where
    ``payloads`` asks for it.
    """
    head, held = _head(b"", pieces)
    fields = dict(x.split(b": ", 1) for x in head.split(CRLF)[1:])
    n, rest, of_block, of_payload, size, kept = int(fields[b"Content-Length"]), [], hashlib.sha1(), hashlib.sha1(), 0, []

    def block():
        for x in _exactly(n, held, pieces, rest):
            of_block.update(x)
            yield x

    inner = block()
    http, first = _head(b"", inner)
    body = [first] if first else []
    while body or (more := next(inner, None)) is not None:
        x = body.pop() if body else more
        of_payload.update(x)
        size += len(x)
        if payloads:
            kept.append(x)
    tail = (rest[0] if rest else b"") + b"".join(pieces)
    base32 = lambda h: base64.b32encode(h.digest())
    told = lambda k: fields[k].removeprefix(b"sha1:")
    kind, claimed = fields[b"WARC-Type"].decode(), int(http.rsplit(b"Content-Length: ", 1)[1])
    whole = tail == CRLF * 2 and base32(of_block) == told(b"WARC-Block-Digest")
    return {
        "record_type": kind,
        "page_id": _page(fields[b"WARC-Record-ID"]),
        "url": _unline(fields[b"WARC-Target-URI"].decode("utf-8", "surrogatepass")) if b"WARC-Target-URI" in fields else None,
        "payload": b"".join(kept) if kind == "response" and payloads else None,
        "payload_bytes": claimed,
        "payload_digest": told(b"WARC-Payload-Digest").decode(),
        "refers_to": _page(fields.get(b"WARC-Refers-To")),
        "intact": whole and (size == 0 if kind == "revisit" else size == claimed and base32(of_payload) == told(b"WARC-Payload-Digest")),
    }


def parse(raw: bytes) -> dict:
    """``frame`` of one inflated record."""
    return frame(iter([raw]))


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, size, sha, refers_to and response (the record as a response) of each row of ``pages(page_id, url, html)``.

    Responses are compressed before anything is joined, so that what may be
    shuffled is as small as the archives.  Payloads are hashed a second time for
    their groups, which costs less than the disk for keeping the records.  Only
    groups of two and more equal payloads are joined back; Spark broadcasts them
    where their size allows and splits a hot payload otherwise.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))

    def press(batches):
        for b in batches:
            size, sha, made = [], [], []
            for row in b.to_pylist():
                size.append(len(row["payload"]))
                sha.append(digest(row["payload"]))
                made.append(record(row["page_id"], row["url"], row["payload"], size[-1], sha[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(made, pa.binary())], ["page_id", "url", "size", "sha", "response"])

    def name(batches):
        for b in batches:
            own = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([digest(x) for x in own], pa.string())], ["page_id", "size", "sha"])

    names = rows.select("page_id", "payload").mapInArrow(name, "page_id long, size long, sha string").where(F.col("size") >= least)
    groups = names.groupBy("sha", "size").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _top is not null").drop("_n")
    made = rows.mapInArrow(press, "page_id long, url string, size long, sha string, response binary")
    later = F.col("page_id").isNull() | (F.col("_top") > F.col("page_id"))
    return made.join(groups, ["sha", "size"], "left").select("page_id", "url", "size", "sha", F.when(later, F.col("_top")).alias("refers_to"), "response")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes each partition as one ``.warc.gz`` under ``folder``; one row an archive: archive, records, bytes.

    A task writes to a name of its own and renames it when whole, so a task that
    runs again, or twice at once, leaves whole archives only; the rows that the
    successful tasks return name those that count.
    """

    def run(batches):
        files, root = _store(folder)
        files.create_dir(root, recursive=True)
        name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
        with files.open_output_stream(f"{name}.part", compression=None) as out:
            for b in batches:
                for row in b.to_pylist():
                    raw = row["response"]
                    if row["refers_to"] is not None:
                        raw = record(row["page_id"], row["url"], None, row["size"], row["sha"], row["refers_to"])
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
        if not n:
            files.delete_file(f"{name}.part")
            return
        files.move(f"{name}.part", name)
        yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [size]})

    return records.mapInArrow(run, "archive string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives named in ``archives(archive)``, with ``READ``'s columns.

    ``payloads=False`` leaves out the payload after its digest is verified.
    """

    def run(batches):
        files, _ = _store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(name, compression=None) as stream:
                    for pieces in members(stream):
                        rows.append(frame(pieces, payloads) | {"archive": name})
                        held += len(rows[-1]["payload"] or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(READ))
    return archives.select("archive").mapInArrow(run, READ)


def archive_pages(pages: DataFrame, least: int = 0, payloads: bool = True) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads every record back.

    A null html is an empty payload.  A row without a page_id has a record without
    one: a revisit where another row has its payload and a page_id, else a response.
    Rows that repeat a page_id have a record each; those with the largest
    page_id of a payload are all responses.  An html is held whole while it is
    compressed.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = Scratch(spark, "warc-index").put(write_archives(plan_records(pages, least), folder))
    return read_archives(written.repartition(max(1, written.count()), "archive"), folder, payloads)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all ``pages`` say of each page."""
    read = archive_pages(table(spark, sf_dir, "pages"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op9_sql() -> str:
    """The same in DuckDB; SHA-1 in base 32 comes from the hexadecimal digits, five bits at a time."""
    return """
with p as (
  select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as n from pages
), d as (
  select page_id, n, max(page_id) over (partition by payload) as top,
    array_to_string(list_transform(from_hex(sha1(payload))::bit::varchar.regexp_extract_all('.{5}'),
      lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::bit::integer + 1, 1)), '') as digest
  from p
)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when top = page_id or top is null then 'response' else 'revisit' end as record_type,
  case when top > page_id or page_id is null then top end as refers_to, true as intact
from d"""
