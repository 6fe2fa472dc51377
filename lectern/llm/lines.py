"""Line deduplication by content-defined chunks.

A rolling hash over the hashes of the last two lines decides where a chunk ends,
so equal passages are cut alike wherever they stand.  ``dedup_lines`` removes the
chunks that occur at an earlier place.

``dedup_runs`` removes every line of a run of lines that occurs at an earlier
place, if the run has two and more lines with ink or 50 and more words.  Chunks
that occur earlier go whole.  What they leave are the ends of passages, which no
two chunk ends enclose, and runs inside of chunks that differ.  A run is covered
by its units: its pairs of following lines with ink (with the blank lines between
them) and its lines of 50 and more words.  So the units of chunks are compared
too, those of equal chunks once, and those that lie across chunk ends.  As every
unit of a text is in a chunk that goes or is compared, no run is missed,
wherever it begins or ends.

In both, bytes are compared with those of the first occurrence.  Whole texts are shuffled once, to meet the list of their repeated chunks.  The
bytes of chunks are compared by grouping on (digest, bytes), which combines on
the map side, so a chunk of many documents weighs little.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

MASK = (1 << 64) - 1
WORDS = re.compile(WORD)
Cut = Callable[[str | None], list[str]]


def chunk_spans(lines: list[str], window: int = 2, mean: int = 4, most: int = 64) -> list[tuple[int, int]]:
    """(first, last) of chunks of following lines, ``mean`` lines long on the average and ``most`` at most."""
    hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = ((rolling << 1) ^ h) & MASK if window > 1 else h
        if i >= window:
            rolling ^= (hashes[i - window] << window) & MASK
        if (rolling >> 20) % mean == 0 or i == len(lines) - 1 or i - start == most - 1:
            out.append((start, i))
            start = i + 1
    return out


def chunks_of(text: str | None, window: int = 2, mean: int = 4) -> list[str]:
    """A text cut into chunks of whole lines; their concatenation is the text."""
    lines = text.split("\n") if text else []
    return ["\n".join(lines[a : b + 1]) + "\n" * (b < len(lines) - 1) for a, b in chunk_spans(lines, window, mean)]


def inked_lines(chunk: str) -> int:
    return sum(1 for x in chunk.split("\n") if x.strip())


def spans_of(lines: list[str], least_lines: int = 2, least_words: int = 50) -> list[tuple[int, int]]:
    """(first, last) of the units: ``least_lines`` following lines with ink, and lines with ink of ``least_words`` and more words."""
    ink = [i for i, x in enumerate(lines) if x and not x.isspace()]
    out = [(i, ink[k + least_lines - 1]) for k, i in enumerate(ink[: len(ink) - least_lines + 1])]
    if least_lines > 1:
        out += [(i, i) for i in ink if len(lines[i]) >= 2 * least_words - 1 and len(WORDS.findall(lines[i])) >= least_words]
    return out


def units_of(text: str | None, least_lines: int = 2, least_words: int = 50) -> list[str]:
    """The units of a text, without the newline after them."""
    lines = text.split("\n") if text else []
    return ["\n".join(lines[a : b + 1]) for a, b in spans_of(lines, least_lines, least_words)]


def inner_units(lines: list[str], spans: list[tuple[int, int]], chunks: list[tuple[int, int]]) -> list[list[int]]:
    """Of each chunk, the numbers of the units that lie in it."""
    chunk_at = [c for c, (a, b) in enumerate(chunks) for _ in range(a, b + 1)]
    out: list[list[int]] = [[] for _ in chunks]
    for k, (a, b) in enumerate(spans):
        if chunk_at[a] == chunk_at[b]:
            out[chunk_at[a]].append(k)
    return out


def _row() -> Column:
    """Name of a row, which equal (doc_id, text) share."""
    return F.concat_ws(":", F.xxhash64("doc_id", "text").cast("string"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("string")).alias("_row")


def repeated_chunks(docs: DataFrame, scratch: Scratch, least_lines: int = 2, cut: Cut = chunks_of) -> DataFrame:
    """(_row, wanted): of each document the chunks whose digest occurs more than once, each with its place and whether it is the first."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def name(batches):
        for b in batches:
            ids, keys, no, key = [], [], [], []
            for i, text, row in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                for k, chunk in enumerate(cut(text)):
                    if not least_lines or inked_lines(chunk) >= least_lines:
                        ids.append(i), keys.append(row), no.append(k), key.append(xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(keys, pa.string()), pa.array(no, pa.int32()), pa.array(key, pa.binary())], ["doc_id", "_row", "no", "key"])

    rows = docs.select("doc_id", "text", _row())
    chunks = scratch.put(rows.mapInArrow(name, f"doc_id {kind}, _row string, no int, key binary"))
    first = chunks.groupBy("key").agg(F.min(F.struct("doc_id", "_row", "no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = scratch.put(first)  # a table of its own has a shuffle of its own, so that a common chunk's rows can be split
    return scratch.put(_wanted(_again(chunks, first)))


def _again(parts: DataFrame, first: DataFrame) -> DataFrame:
    """(key, _row, no, is_first) of the parts whose key is in ``first``."""
    same = (F.col("_row") == F.col("first._row")) & (F.col("no") == F.col("first.no"))
    return parts.join(first.hint("merge"), "key").select("key", "_row", "no", same.alias("is_first"))


def _wanted(again: DataFrame) -> DataFrame:
    return again.groupBy("_row").agg(F.collect_set(F.struct("no", "key", "is_first")).alias("wanted"))


def repeated_runs(docs: DataFrame, scratch: Scratch, least_lines: int = 2, least_words: int = 50) -> DataFrame:
    """(_row, wanted) as of ``repeated_chunks``, of chunks and of the units that repeated chunks leave.

    Units are numbered first, chunks after them.  Equal chunks have equal units,
    so the units of a chunk are listed for its first occurrence only.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    units = pa.list_(pa.struct([("no", pa.int32()), ("key", pa.binary())]))

    def name(batches):
        for b in batches:
            ids, keys, no, key, within = [], [], [], [], []
            for i, text, row in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                lines = text.split("\n") if text else []
                spans, chunks = spans_of(lines, least_lines, least_words), chunk_spans(lines)
                digests = [xxhash.xxh3_128_digest("\n".join(lines[x : y + 1]).encode("utf-8", "surrogatepass")) for x, y in (*spans, *chunks)]
                across = set(range(len(spans)))
                for c, own in enumerate(inner_units(lines, spans, chunks), len(spans)):
                    if own:
                        across.difference_update(own)
                        ids.append(i), keys.append(row), no.append(c), key.append(digests[c]), within.append([{"no": k, "key": digests[k]} for k in own])
                for k in sorted(across):
                    ids.append(i), keys.append(row), no.append(k), key.append(digests[k]), within.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(keys, pa.string()), pa.array(no, pa.int32()), pa.array(key, pa.binary()), pa.array(within, units)], ["doc_id", "_row", "no", "key", "units"])

    rows = docs.select("doc_id", "text", _row())
    parts = scratch.put(rows.mapInArrow(name, f"doc_id {kind}, _row string, no int, key binary, units array<struct<no:int,key:binary>>"))
    place, n = F.struct("doc_id", "_row", "no"), F.count(F.lit(1)).alias("n")
    chunks, across = parts.where("units is not null"), parts.where("units is null").drop("units")
    distinct = scratch.put(chunks.groupBy("key").agg(F.min(F.struct("doc_id", "_row", "no", "units")).alias("first"), n))
    inside = distinct.select("first.doc_id", "first._row", F.explode("first.units").alias("u")).select("doc_id", "_row", "u.no", "u.key")
    left = across.unionByName(inside)
    first = scratch.put(left.groupBy("key").agg(F.min(place).alias("first"), n).where("n > 1").drop("n"))
    whole = scratch.put(distinct.where("n > 1").select("key", F.struct("first._row", "first.no").alias("first")))
    return scratch.put(_wanted(_again(chunks, whole).unionByName(_again(left, first))))


def unequal_chunks(held: DataFrame, scratch: Scratch, cut: Cut = chunks_of) -> DataFrame:
    """(key, bytes) of chunks that share their digest with a first occurrence, but not its bytes."""

    def parts_of(batches):
        for b in batches:
            for text, wanted in zip(*(b.column(j).to_pylist() for j in range(2)), strict=True):
                own = cut(text)
                parts = [own[w["no"]].encode("utf-8", "surrogatepass") for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([w["key"] for w in wanted], pa.binary()), pa.array(parts, pa.binary()), pa.array([w["is_first"] for w in wanted], pa.bool_())], ["key", "bytes", "is_first"])

    parts = held.where("wanted is not null").select("doc.text", "wanted").mapInArrow(parts_of, "key binary, bytes binary, is_first boolean")
    return scratch.put(parts.groupBy("key", "bytes").agg(F.max("is_first").alias("kept")).where("not kept").select("key", "bytes"))


def with_repeats(docs: DataFrame, scratch: Scratch, cut: Cut, wanted: DataFrame, otherwise: Callable[[], DataFrame] | None = None) -> DataFrame:
    """doc (the row of ``docs``) and gone (numbers of its parts, of those ``wanted``, that repeat the bytes of an earlier one).

    ``otherwise`` is the result if bytes of equal digests differ; without it, such parts stay.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _row())
    held = scratch.put(rows.join(wanted.hint("merge"), "_row", "left"))
    unequal = unequal_chunks(held, scratch, cut)
    if not unequal.isEmpty():  # only where digests of different chunks are equal
        if otherwise:
            return otherwise()
        held = scratch.put(_without(held, unequal, cut))
    return held.select("doc", F.transform(F.filter("wanted", lambda w: ~w["is_first"]), lambda w: w["no"]).alias("gone"))


def _without(held: DataFrame, unequal: DataFrame, cut: Cut = chunks_of) -> DataFrame:
    """``held`` whose ``wanted`` names none of the ``unequal`` chunks."""

    def parts_of(batches):
        for b in batches:
            for row, text, wanted in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                own = cut(text)
                parts = [own[w["no"]].encode("utf-8", "surrogatepass") for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.string()), pa.array([w["no"] for w in wanted], pa.int32()), pa.array([w["key"] for w in wanted], pa.binary()), pa.array(parts, pa.binary())], ["_row", "no", "key", "bytes"])

    named = held.select("_row", "doc.text", F.explode("wanted").alias("w")).join(unequal.select("key").distinct(), F.col("w.key") == F.col("key"), "left_semi")
    named = named.select("_row", "text", F.array("w").alias("wanted"))
    parts = named.mapInArrow(parts_of, "_row string, no int, key binary, bytes binary")
    stay = parts.join(unequal, ["key", "bytes"], "left_semi").groupBy("_row").agg(F.collect_set("no").alias("_stay"))
    kept = F.filter("wanted", lambda w: ~F.array_contains(F.coalesce("_stay", F.array().cast("array<int>")), w["no"]))
    return held.join(stay, "_row", "left").withColumn("wanted", kept).drop("_stay")


def dedup_lines(docs: DataFrame, least_lines: int = 2) -> DataFrame:
    """``docs`` with cleaned texts in ``text``, and _lines, _removed_lines, _chunks, _removed_chunks.

    The first occurrence is the one with the smallest (doc_id, text hash, place).
    Rows that repeat a doc_id and its text count as one and keep the same.  A
    null doc_id is before all others.  Columns of ``docs`` with the names of added
    ones are replaced, others stay.  A null text stays null, an empty one
    empty; chunks with fewer than ``least_lines`` lines that hold ink stay.
    """

    def rest(text, gone):
        own, drop = chunks_of(text), set(gone or ())
        lines = [x.count("\n") + (not x.endswith("\n")) for x in own]
        return text if not drop else "".join(x for k, x in enumerate(own) if k not in drop), sum(lines), sum(lines[k] for k in drop), len(own), len(drop)

    def found(docs, scratch):
        return with_repeats(docs, scratch, chunks_of, repeated_chunks(docs, scratch, least_lines))

    return _cleaned(docs, rest, found)


def dedup_runs(docs: DataFrame, least_lines: int = 2, least_words: int = 50) -> DataFrame:
    """``docs`` as of ``dedup_lines``, but without the lines of any run that occurs at an earlier place.

    A run begins and ends with a line with ink and has ``least_lines`` and more
    of these, or ``least_words`` and more words.  Every distinct line stays where
    it occurs first; earlier places have a smaller (doc_id, text hash, line), and
    two places may overlap.  A newline after the last line is no part of it.
    _removed_chunks counts the chunks that occur earlier as a whole, and the
    further column _chunk_lines the lines that go with these alone.
    """

    def units(text):
        return units_of(text, least_lines, least_words)

    def cut(text):
        lines = text.split("\n") if text else []
        return units(text) + ["\n".join(lines[a : b + 1]) for a, b in chunk_spans(lines)]

    def rest(text, gone):
        lines = text.split("\n") if text else []
        spans, chunks = spans_of(lines, least_lines, least_words), chunk_spans(lines)
        inner = inner_units(lines, spans, chunks) if gone else []
        whole = [k - len(spans) for k in gone or () if k >= len(spans)]
        by_chunk = {i for c in whole for k in inner[c] for i in range(spans[k][0], spans[k][1] + 1)}
        drop = by_chunk | {i for k in gone or () if k < len(spans) for i in range(spans[k][0], spans[k][1] + 1)}
        return text if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop), len(chunks), len(whole), len(by_chunk)

    def found(docs, scratch):
        def by_units():
            return with_repeats(docs, scratch, units, repeated_chunks(docs, scratch, 0, units))

        return with_repeats(docs, scratch, cut, repeated_runs(docs, scratch, least_lines, least_words), by_units)

    return _cleaned(docs, rest, found, "_chunk_lines")


def _cleaned(docs: DataFrame, rest: Callable, found: Callable[[DataFrame, Scratch], DataFrame], *more: str) -> DataFrame:
    """``docs`` with what ``rest`` gives for a text and the numbers of its parts that are ``found``: the text that stays, and counts."""
    scratch = Scratch(docs.sparkSession, "lines")
    added = ("_lines", "_removed_lines", "_chunks", "_removed_chunks", *more)
    docs = docs.drop(*added)
    names = docs.columns
    joined = found(docs, scratch).select(*[F.col(f"doc.`{c}`").alias(f"c{j}") for j, c in enumerate(names)], "gone")
    at = names.index("text")

    def clean(batches):
        for b in batches:
            got = [rest(*x) for x in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            arrays = [b.column(j) for j in range(len(names))]
            arrays[at] = pa.array([x[0] for x in got], b.schema.field(at).type)
            arrays += [pa.array([x[j] for x in got], pa.int64()) for j in range(1, len(added) + 1)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *added])

    from pyspark.sql.types import LongType, StructField, StructType

    return joined.mapInArrow(clean, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in added)]))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every row of ``documents``."""
    rows = dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_removed_lines").alias("removed_lines"),
        F.col("_chunks").alias("n_chunks"),
        F.col("_removed_chunks").alias("removed_chunks"),
        F.col("_chunk_lines").alias("chunk_lines"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("kept_crc32"),
    )
