"""Document fingerprints by randomised edit embedding.

A walk goes over the characters of a text in steps; at each step a random bit,
shared by all texts and drawn from the step and the character, says whether the
walk goes on to the next character.  What the walk reads at each step is the
embedding: texts at a small edit distance fall into step again after an edit, so
they differ at few steps.  A fingerprint keeps one bit of what is read at sampled
steps.  Steps are sampled by level, each twice as long as those before, so short
and long texts have samples in common, and the share of unequal bits of a level,
weighed by its length, estimates the share of unequal steps.

Banding: a band reads some bits of one level; texts that agree in a band are
candidates, and are verified by the likeness of their whole fingerprints and then
by the edit distance of their texts.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Steps after which the shared bits repeat, kinds of characters that have bits of their own, samples of a level.
PERIOD, KINDS, SAMPLES = 4096, 256, 128
END = 0x110000  # what is read after the end of a text; no character


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of arrays of integers, the same on every machine."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return h


@cache
def advances() -> list[list[int]]:
    """For each kind of character and step modulo the period: the steps until the walk has gone on."""
    go = (mixed(1, np.arange(KINDS)[:, None], np.arange(PERIOD)[None, :]) >> np.uint64(40)) & np.uint64(1)
    at = np.where(np.tile(go, 2) == 1, np.arange(2 * PERIOD), 4 * PERIOD)
    nxt = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (nxt - np.arange(PERIOD) + 1).tolist()


@cache
def sampled_steps(level: int) -> np.ndarray:
    """The steps of a level, ascending: all of the first, else ``SAMPLES`` drawn from its range."""
    if not level:
        return np.arange(SAMPLES)
    low = SAMPLES << (level - 1)
    return np.sort(low + (mixed(2, level, np.arange(SAMPLES)) % np.uint64(low)).astype(np.int64))


@cache
def steps_to(levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps of the first levels, and their hashes."""
    steps = np.concatenate([sampled_steps(k) for k in range(levels)])
    return steps, mixed(3, steps)


def _bits(codes: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """One bit of each character that is read at a step with that hash."""
    return ((mixed(hashed, codes) >> np.uint64(33)) & np.uint64(1)).astype(np.uint8)


@cache
def blank_bits(level: int) -> int:
    """What a level reads after the end of a text."""
    return int.from_bytes(np.packbits(_bits(np.full(SAMPLES, END), mixed(3, sampled_steps(level)))).tobytes(), "big")


def levels_of(steps: int) -> int:
    """How many levels a walk of so many steps reaches; one at least."""
    return 1 + max(0, -(-steps // SAMPLES) - 1).bit_length()


@cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    return (mixed(4, np.arange(END + 1)) % np.uint64(KINDS)).astype(np.uint8)


@cache
def flat_advances() -> np.ndarray:
    return np.array(advances(), dtype=np.int64).ravel()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def walks(texts: list[np.ndarray], firsts: list[int] | None = None, together: int = 48) -> list[np.ndarray]:
    """For each text the steps at which its characters are first read, and last the step behind them; walks begin at ``firsts``.

    All texts go on together, the long ones first in line, with their characters
    side by side, as long as enough are left; the rest of a long text is walked alone.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    at = np.array([firsts[i] if firsts else 0 for i in order], dtype=np.int64)
    begun = at.copy()
    shared = int(sizes[together - 1]) if len(sizes) >= together else 0  # characters that all of the longest have
    head = np.minimum(sizes, shared)
    live = np.bincount(head, minlength=shared + 1)[::-1].cumsum()[::-1][1:] if shared else np.zeros(0, np.int64)  # texts that have a place, by place
    row = np.concatenate(([0], np.cumsum(live)))
    first_char = np.concatenate(([0], np.cumsum(head)))
    cell = row[np.arange(first_char[-1]) - np.repeat(first_char[:-1], head)] + np.repeat(np.arange(len(sizes)), head)
    kind, flat, mask = kinds(), flat_advances(), PERIOD - 1
    laid = np.empty(len(cell), dtype=np.int64)
    if len(cell):
        laid[cell] = kind[np.concatenate([texts[i][:n] for i, n in zip(order, head, strict=True)])].astype(np.int64) * PERIOD
    steps = np.empty(len(cell), dtype=np.int64)
    for t in range(shared):
        a, b = row[t], row[t + 1]
        own = at[: b - a]
        own += flat[laid[a:b] + (own & mask)]
        steps[a:b] = own
    steps = steps[cell]
    out: list[np.ndarray] = [None] * len(texts)
    rows = advances()
    for k, i in enumerate(order):
        start, n = int(begun[k]), int(head[k])
        parts = [np.array([start], dtype=np.int64), steps[first_char[k] : first_char[k] + n]]
        if n < len(texts[i]):
            step, rest = int(at[k]), []
            push = rest.append
            for own in map(rows.__getitem__, kind[texts[i][n:]].tobytes()):
                step += own[step & mask]
                push(step)
            parts.append(np.array(rest, dtype=np.int64))
        out[i] = np.concatenate(parts)
    return out


def fingerprint(codes: np.ndarray, starts: np.ndarray) -> str:
    """Number of steps and the bits of every level that the walk reaches, in hex."""
    steps = int(starts[-1])
    at, hashed = steps_to(levels_of(steps))
    read = np.full(len(at), END, dtype=np.int64)
    seen = np.flatnonzero(at < steps)
    read[seen] = codes[np.searchsorted(starts, at[seen], side="right") - 1]
    return f"{steps:x}-{np.packbits(_bits(read, hashed)).tobytes().hex()}"


def fingerprints(texts: list[str]) -> list[str]:
    codes = [code_points(t) for t in texts]
    return [fingerprint(c, w) for c, w in zip(codes, walks(codes), strict=True)]


def unpacked(mark: str) -> tuple[int, np.ndarray]:
    """(steps, bits by level) of a fingerprint."""
    steps, _, bits = mark.partition("-")
    return int(steps, 16), np.unpackbits(np.frombuffer(bytes.fromhex(bits), dtype=np.uint8)).reshape(-1, SAMPLES)


def likeness(a: str, b: str) -> float:
    """1 less the estimated share of unequal steps; 1 for equal fingerprints, at least 0.

    Unequal characters give unequal bits half the time, so a share of unequal bits counts twice.
    """
    if a == b:
        return 1.0
    (n, x), (m, y) = ((int(s, 16), [int(bits[k : k + SAMPLES // 4], 16) for k in range(0, len(bits), SAMPLES // 4)]) for s, _, bits in (z.partition("-") for z in (a, b)))
    end, unequal, weight = max(n, m), 0.0, 0
    for level in range(max(len(x), len(y))):
        low, high = SAMPLES << (level - 1) if level else 0, SAMPLES << level
        seen = SAMPLES if high <= end else int(np.searchsorted(sampled_steps(level), end))  # later samples are behind both ends
        if seen:
            p, q = (z[level] if level < len(z) else blank_bits(level) for z in (x, y))
            own = min(end, high) - low
            unequal += own * min(1.0, 2 * ((p ^ q) >> (SAMPLES - seen)).bit_count() / seen)
            weight += own
    return max(0.0, 1.0 - unequal / weight) if weight else 1.0


def edited_text(text: str, after: str) -> str:
    """The last half of a text (rounded down) replaced by as many first characters of the text after it, or all."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def compared(texts: list[str], codes: list[np.ndarray], steps: list[np.ndarray], marks: list[str], after: list[int]) -> list[tuple]:
    """Of each text with the one numbered ``after``: edited digest, edited fingerprint, both likenesses.

    The walk over an edited text goes on from that over the half that stays.
    """
    halves = [len(c) // 2 for c in codes[: len(after)]]
    kept = [len(c) - n for c, n in zip(codes, halves, strict=False)]
    new = [codes[j][:n] for j, n in zip(after, halves, strict=True)]
    tails = walks(new, [int(w[k]) for w, k in zip(steps, kept, strict=False)])
    out = []
    for i, (j, k) in enumerate(zip(after, kept, strict=True)):
        mark = fingerprint(np.concatenate([codes[i][:k], new[i]]), np.concatenate([steps[i][:k], tails[i]]))
        edited = edited_text(texts[i], texts[j])
        out.append((hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, likeness(marks[i], mark), likeness(marks[i], marks[j])))
    return out


def in_lots(texts: list[str], most: int = 1 << 22):
    """(first, last) of runs of texts with about ``most`` characters together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


ADDED = "edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs(doc_id, text)``.

    The next document is that of the next doc_id; equal doc_ids are in the order
    of a hash of their texts, then of the texts, and null doc_ids come first.  A
    single row is its own next.  A null text is empty; an empty text has a
    fingerprint of no steps and is like another empty one only.  Other columns
    are ignored.

    Texts are sorted into ranges, in one shuffle.  A task goes over its range with
    one text at hand besides the next; the last row of a range is finished after,
    with the first of the next range that has rows: one row for each range.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "fingerprints")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("lot"))
    rows = rows.repartitionByRange(ranges, "doc_id", "lot").sortWithinPartitions("doc_id", "lot", "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["part", "doc_id", "n_chars", *(x.split()[0] for x in ADDED.split(", ")), "head", "head_fingerprint", "tail"]

    def go(batches):
        held = head = None
        at_part = 0

        def out(found):
            types = [pa.int32(), id_type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), *[pa.string()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [[]] * len(names), types, strict=True)], names)

        for b in batches:
            id_type = b.column(1).type
            parts, ids, every = (b.column(j).to_pylist() for j in range(3))
            for first, last in in_lots(every):
                texts = every[first:last]
                codes = [code_points(t) for t in texts]
                steps = walks(codes)
                marks = [fingerprint(c, w) for c, w in zip(codes, steps, strict=True)]
                own = ids[first:last]
                if held:
                    own, texts, codes, steps, marks = ([h, *x] for h, x in zip(held, (own, texts, codes, steps, marks), strict=True))
                else:
                    head, at_part = (texts[0], marks[0]), parts[first]
                got = compared(texts, codes, steps, marks, list(range(1, len(texts))))
                yield out([(at_part, own[k], len(codes[k]), sha, marks[k], other, near, following, None, None, None) for k, (sha, other, near, following) in enumerate(got)])
                held = [x[-1] for x in (own, texts, codes, steps, marks)]
        if held:
            yield out([(at_part, held[0], len(held[1]), None, held[4], None, None, None, *head, held[1])])

    done = scratch.put(rows.mapInArrow(go, f"part int, doc_id {kind}, n_chars long, {ADDED}, head string, head_fingerprint string, tail string"))
    last = done.where("tail is not null")  # one row for each range
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = last.select("part", F.lead("part").over(order).alias("next"), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"))
    ends = ends.select("part", F.coalesce("next", "least").alias("next"))
    heads = last.select(F.col("part").alias("next"), F.col("head").alias("after"), F.col("head_fingerprint").alias("after_mark"))
    joined = last.select("part", "doc_id", "n_chars", "tail", "fingerprint").join(ends, "part").join(heads, "next").select("doc_id", "n_chars", "tail", "fingerprint", "after", "after_mark")

    def finish(batches):
        for b in batches:
            got = []
            for text, mark, after, after_mark in zip(*(b.column(j).to_pylist() for j in range(2, 6)), strict=True):
                codes = [code_points(t) for t in (text, after)]
                got += compared([text, after], codes, walks(codes[:1]), [mark, after_mark], [1])
            cols = list(zip(*got, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()), b.column(3), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], ["doc_id", "n_chars", *(x.split()[0] for x in ADDED.split(", "))])

    ended = joined.mapInArrow(finish, f"doc_id {kind}, n_chars long, {ADDED}")
    return done.where("tail is null").select(*ended.columns).unionByName(ended)


def fingerprints_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint) of every row of ``docs(doc_id, text)``; a null text is empty. No row is shuffled."""

    def go(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            marks = [m for first, last in in_lots(texts) for m in fingerprints(texts[first:last])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(marks, pa.string())], ["doc_id", "text", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(go, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, fingerprint string")


def band_keys(fingerprint: str, bands: int = 16, bits: int = 24) -> list[int]:
    """Keys of the bands of a fingerprint: sampled bits of the two last levels that its walk fills.

    Two texts whose lengths differ by less than half share one of these levels at
    least.  A text that fills none is banded by its first level, ends included.
    """
    _, own = unpacked(fingerprint)
    last = max(0, len(own) - 2)
    keys = []
    for level in range(max(0, last - 1), last + 1):
        for band in range(bands):
            at = (mixed(5, level, band, np.arange(bits)) % np.uint64(SAMPLES)).astype(np.int64)
            keys.append(int(mixed(6, level, band, int.from_bytes(np.packbits(own[level][at]).tobytes(), "big")).astype(np.int64)))
    return keys


def within(a: str, b: str, share: float) -> bool:
    """Whether the edit distance of two texts is at most ``share`` of the longer one's characters.

    Furthest reaching points by diagonal, so the work is bounded by the distance
    allowed times the length, and equal stretches are skipped as slices.
    """
    most = int(share * max(len(a), len(b)))
    if abs(len(a) - len(b)) > most:
        return False
    x, y = code_points(a), code_points(b)

    def slide(i: int, j: int) -> int:
        step = 64
        while i < len(x) and j < len(y):
            n = min(step, len(x) - i, len(y) - j)
            unequal = np.flatnonzero(x[i : i + n] != y[j : j + n])
            if len(unequal):
                return i + int(unequal[0])
            i, j, step = i + n, j + n, step * 2
        return i

    reach = {0: slide(0, 0)}
    for _ in range(most + 1):
        if reach.get(len(x) - len(y), -1) >= len(x):
            return True
        new = {}
        for k in range(min(reach) - 1, max(reach) + 2):
            # a substitution keeps the diagonal, an insertion comes from k + 1 and a deletion from k - 1
            i = max(reach.get(k, -2) + 1, reach.get(k + 1, -1), reach.get(k - 1, -2) + 1)
            i = min(i, len(x), len(y) + k)
            if i >= max(0, k):
                new[k] = slide(i, i - k)
        reach = new
    return False


def near_copies(docs: DataFrame, least: float = 0.5, share: float = 0.1, bands: int = 16, bits: int = 24) -> DataFrame:
    """(doc_id, near_id): for each row, the smallest doc_id that shares a band with it and is verified to be near; its own where there is none.

    Equal fingerprints are compared once, by their smallest doc_id.  In a band every
    class meets the band's smallest doc_id only, so a band of many texts gives no
    pairs of them.  Candidates are verified by likeness (``least``), then by edit
    distance (``share`` of the longer text).
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    marked = scratch.put(fingerprints_of(docs.where("doc_id is not null")))
    classes = scratch.put(marked.groupBy("text", "fingerprint").agg(F.min("doc_id").alias("class_id")))
    keys = F.udf(lambda f: band_keys(f, bands, bits), "array<bigint>")(F.col("fingerprint"))
    banded = scratch.put(classes.select("class_id", F.explode(keys).alias("key")))
    least_of = banded.groupBy("key").agg(F.min("class_id").alias("near_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = banded.join(least_of, "key").where("class_id > near_id").select("class_id", "near_id").distinct()
    texts = classes.select("class_id", "text", "fingerprint")
    named = pairs.join(texts, "class_id").join(texts.select(*[F.col(c).alias(f"near_{c}") for c in ("text", "fingerprint")], F.col("class_id").alias("near_id")), "near_id")

    def verify(batches):
        for b in batches:
            cols = {c: b.column(j).to_pylist() for j, c in enumerate(b.schema.names)}
            fine = [likeness(f, g) >= least and within(x, y, share) for f, g, x, y in zip(cols["fingerprint"], cols["near_fingerprint"], cols["text"], cols["near_text"], strict=True)]
            yield b.select(["class_id", "near_id"]).filter(pa.array(fine, pa.bool_()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    near = named.mapInArrow(verify, f"class_id {kind}, near_id {kind}").groupBy("class_id").agg(F.min("near_id").alias("near_id"))
    member = marked.select("doc_id", "text", "fingerprint").join(classes, ["text", "fingerprint"]).select("doc_id", "class_id")
    return member.join(near, "class_id", "left").select("doc_id", F.coalesce("near_id", "class_id").alias("near_id"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text, with their likenesses."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
