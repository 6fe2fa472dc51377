"""N-gram Jaccard join: size-aware, with fixed-size subsets for light sets and inverted lists for heavy ones.

A document's set holds the 64-bit hashes of its distinct word shingles.  Equal
sets are one class.  In a global order (frequent shingles last) two sets with
Jaccard similarity t or more share one of their first ``n - ceil(t n) + 1``
shingles, and two of their first ``n - ceil(t n) + 2``.  Light sets are listed
under every 2-subset of the latter, heavy sets under each of the former; sets
little above the boundary are listed both ways so that a light set meets them.
The boundary is the size at which the histogram of sizes makes the listing
cheapest.

What is asked for is which sets hang together, so no list emits all its pairs.
Each set of a list is first checked against two hubs of the list, and the links
found are contracted.  Of lists of the same sets one goes on.  Sets of a list that
are still apart are checked against a few more hubs, those with the fewest rare
shingles: a set that others were made from has no edits of its own, so copies that
differ too much from each other meet in it.  Only what is apart after that is met
pair by pair, in a join whose condition holds the sizes and small parity bitmaps
against each other.  Every pair of linked sets shares a list, so it is either
checked or already known to hang together: no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

U = np.uint64
#: Odd multipliers of the hash functions.
_P, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_P_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _mix((_LOWER.astype(np.uint64) + U(1)) * _P)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def shingle_hashes(text: str | None, k: int = 5) -> np.ndarray:
    """Hash of every run of k words, in order; of the whole sequence where there are fewer; none without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    ink = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(raw) + k + 4)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    words = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M2)
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64) * _M2
    for i in range(k):
        out += words[i : i + len(out)] * up[i + 3]
    return _mix(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same > 0 and 100 * same >= percent * (len(a) + len(b) - same)


SIZES = 1024
#: Frequent shingles that the order knows, cells of the table that names them, and shingles that a task counts at a time.
FREQUENT, CELL_BITS, BLOCK = 1 << 18, 22, 1 << 21


def _usage(docs: DataFrame, k: int) -> DataFrame:
    """(sized, h, n): how many sets hold each shingle that repeats inside a task's block of sets; where ``sized`` is true, how many sets have h shingles (SIZES: so many and more).

    Equal sets of a block count once.  A block is of bounded size; counts of all
    blocks are added with a partial aggregation before the shuffle.
    """

    def count(batches):
        sizes, held, seen, n = np.zeros(SIZES + 1, dtype=np.int64), [], set(), 0

        def repeated():
            h, times = np.unique(np.concatenate(held), return_counts=True)
            h, times = h[times > 1], times[times > 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), dtype=bool)), pa.array(h.view(np.int64)), pa.array(times)], ["sized", "h", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                h = shingle_set(text, k)
                sizes[min(len(h), SIZES)] += 1
                name = (len(h), int(h.sum(dtype=U)))
                if len(h) < 2 or name in seen:
                    continue
                seen.add(name)
                held.append(h)
                n += len(h)
                if n > BLOCK:
                    yield from repeated()
                    held, seen, n = [], set(), 0
        if held:
            yield from repeated()
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), dtype=bool)), pa.array(at), pa.array(sizes[at])], ["sized", "h", "n"])

    return docs.select("text").mapInArrow(count, "sized boolean, h long, n long").groupBy("sized", "h").agg(F.sum("n").alias("n"))


def _order(docs: DataFrame, k: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(class of frequency of each cell of shingles, histogram of set sizes up to SIZES), both of fixed size.

    The FREQUENT commonest shingles have the class of their logarithm, all others
    0.  Only the order of shingles depends on it, never a result.
    """
    usage = scratch.put(_usage(docs, k))
    sizes = np.zeros(SIZES + 1, dtype=np.int64)
    for x in usage.where("sized").collect():  # at most SIZES + 1 rows
        sizes[x["h"]] = x["n"]
    steps = usage.where("not sized").groupBy(F.least("n", F.lit(4096)).alias("n")).count().orderBy(F.desc("n")).collect()
    kept, least = 0, 1 << 62
    for x in steps:  # at most 4095 rows
        if kept + x["count"] > FREQUENT:
            break
        kept, least = kept + x["count"], x["n"]
    often = usage.where("not sized").where(F.col("n") >= least).select("h", "n").toPandas()  # at most FREQUENT rows
    scratch.drop(usage)
    rank = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    np.maximum.at(rank, often["h"].to_numpy(np.int64).view(np.uint64) >> U(64 - CELL_BITS), (1 + np.log2(np.maximum(often["n"].to_numpy(np.float64), 1))).astype(np.uint8))
    return rank, sizes


def boundary_of(sizes: np.ndarray, percent: int, scan: float = 3.0) -> int:
    """Largest size of a light set: where 2-subsets and the steps down inverted lists (``scan`` for each entry) cost least in all."""
    n = np.arange(len(sizes), dtype=np.float64)
    rest = n - np.ceil(n * percent / 100)
    subsets, lists = (rest + 2) * (rest + 1) / 2, (rest + 1) * (1 + scan)
    light = np.cumsum(sizes * subsets)
    heavy = (sizes * lists)[::-1].cumsum()[::-1]
    cost = []
    for x in range(2, len(n) - 1):
        both = min(len(n) - 1, x * 100 // percent)
        cost.append(light[both] + heavy[x + 1])
    return 2 + int(np.argmin(cost))


def signatures(h: np.ndarray, rank: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """Lists that the set ``h`` (sorted) is entered in; ``rank`` is its shingles' class of frequency."""
    n = len(h)
    if n < 2:
        return h[:0]  # links with an equal set only
    rest = n - -(-n * percent // 100)
    order = h[np.argsort(rank, kind="stable")]
    out = []
    if n <= boundary * 100 // percent:
        a, b = np.triu_indices(min(n, rest + 2), 1)
        out.append(_mix(order[a] * _M1 + order[b]))
    if n > boundary:
        out.append(_mix(order[: rest + 1] + _M2))
    return np.concatenate(out)


PARITY = 8
#: Hubs of a list in a round, and most rounds before the pairs left are met.
HUBS, ROUNDS = 8, 4


def bitmap(h: np.ndarray) -> bytes:
    """Parity of the shingles in each of n and more classes, a bit each and 64 PARITY at least: two sets differ in at least as many shingles as their bitmaps in bits."""
    m = 1 << max((64 * PARITY - 1).bit_length(), (len(h) - 1).bit_length())
    return np.packbits((np.bincount(((h >> U(16)) & U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes) -> np.ndarray:
    """A bitmap folded to a fixed size, as PARITY 64-bit integers: what the join of a list's sets compares."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, dtype="<i8").reshape(-1, PARITY), axis=0)


def parities_allow(x: str, y: str, percent: int) -> Column:
    """Whether two rows (n, parity) may be linked: their sets differ in at least as many shingles as their parities in bits."""
    apart = sum((F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i])) for i in range(PARITY)), F.lit(0))
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    return 100 * (both - apart) >= percent * (both + apart)


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ; the larger is folded to the size of the smaller."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    k = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, k), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _traits(sketches: DataFrame) -> DataFrame:
    """id, n, rare and parity of each set."""

    def run(batches):
        for b in batches:
            odd = [folded(x) for x in b.column(2).to_pylist()]
            flat = pa.array(np.concatenate(odd) if odd else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1, dtype=np.int32) * PARITY), flat)], ["id", "n", "rare", "parity"])

    return sketches.select("id", "n", "bits", "rare").mapInArrow(run, "id long, n long, rare int, parity array<bigint>")


def _nearly_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps don't rule out; few but links are left."""

    def run(batches):
        for t in batches:
            n, m = (np.array(t.column(j), dtype=np.int64) for j in (2, 3))
            apart = np.array([bits_apart(x, y) for x, y in zip(t.column(4).to_pylist(), t.column(5).to_pylist(), strict=True)], dtype=np.int64)
            same = np.minimum(np.minimum(n, m), (n + m - apart) // 2)
            yield t.select([0, 1]).filter(pa.array(100 * same >= percent * (n + m - same), pa.bool_()))

    side = lambda c, n, p: sketches.select(F.col("id").alias(c), F.col("n").alias(n), F.col("bits").alias(p))
    sized = pairs.join(side("a", "n", "p"), "a").join(sketches.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("q")), "b")
    both = sized.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select("a", "b", "n", "m", "p", "q")
    return both.mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, n (size of the set), its digest, bitmap and signatures (48 bits each), and the thousandths of it that are rare shingles, for every row."""
    rank, sizes = _order(docs, k, scratch)
    boundary = boundary_of(sizes, percent)
    ranks = docs.sparkSession.sparkContext.broadcast(rank.tobytes())  # 4 MB at any scale
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        rank = np.frombuffer(ranks.value, dtype=np.uint8)
        for b in batches:
            n, digest, sig, bits, rare = [], [], [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_set(text, k)
                n.append(len(h))
                bits.append(bitmap(h))
                digest.append(np.array([h.sum(dtype=np.uint64), _mix(h ^ _M1).sum(dtype=np.uint64)]).tobytes())
                own = rank[h >> U(64 - CELL_BITS)]
                rare.append(1000 * int((own == 0).sum()) // max(1, len(h)))
                sig.append(signatures(h, own, boundary, percent).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), pa.array(sig, pa.binary()), pa.array(rare, pa.int32())], ["doc_id", "n", "digest", "bits", "sig", "rare"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, digest binary, bits binary, sig binary, rare int")


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The first ``width`` bytes of 64-bit integers, byte position after byte position, so that equal ones compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(raw: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T
    return out.view(np.int64).ravel()


def _hubs(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, list of each entry in order, first entry of each list, its size, smallest id, an id at random)."""
    by = np.lexsort((ids, sig))
    sig, ids = sig[by], ids[by]
    new = np.concatenate(([True], sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    lot = np.lexsort((_mix(ids.view(np.uint64)), of))
    return by, of, first, np.diff(np.append(first, len(sig))), ids[first], ids[lot[first]]


LISTS = "sig long, id long, h1 long, h2 long, listed boolean"


def _lists(first: DataFrame, scratch: Scratch, bucket_size: int = 1 << 19) -> DataFrame:
    """LISTS of each entry of a list with two and more sets: the set, two hubs, and whether the row is the set's own.

    A task sorts its entries in blocks.  A list with several entries in a block
    gets hubs there, and only one entry of it goes on, as a block of bytes, to the
    bucket of the list.  So no task gets more than one entry of a list from each
    block, and what it gets grows with its share of the distinct lists.
    """
    buckets = (first.agg(F.sum(F.octet_length("sig"))).first()[0] or 0) // 6 // bucket_size + 1
    whole = pa.schema([("sig", pa.int64()), ("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("listed", pa.bool_())])
    shape = pa.schema([("bucket", pa.int32()), ("sig", pa.binary()), ("id", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary()), ("several", pa.binary())])

    def packed(sigs, ids):
        sig, ids = np.concatenate(sigs), np.concatenate(ids)
        by, of, at, size, h1, h2 = _hubs(sig, ids)
        sig, ids, many = sig[by], ids[by], size > 1
        own = many[of]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([_planes(x)], pa.binary()) for x in (sig[own], ids[own], h1[of[own]], h2[of[own]])), pa.array([b""], pa.binary())], schema=shape)
        sig, ids = sig[at], ids[at]
        to = sig % buckets
        by = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[by], np.arange(buckets + 1))
        rows = [(k, by[ends[k] : ends[k + 1]]) for k in range(buckets) if ends[k] < ends[k + 1]]
        none = pa.array([None] * len(rows), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([_planes(sig[x], 6) for _, x in rows], pa.binary()), pa.array([_planes(ids[x]) for _, x in rows], pa.binary()), none, none, pa.array([np.packbits(many[x]).tobytes() for _, x in rows], pa.binary())], schema=shape)

    def deal(batches):
        sigs, ids, n = [], [], 0
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = len(raw) // 6
                own = np.zeros((k, 8), dtype=np.uint8)
                own[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
                sigs.append(own.view(np.int64).ravel())
                ids.append(np.full(k, i, dtype=np.int64))
                n += k
                if n > BLOCK // 2:
                    yield from packed(sigs, ids)
                    sigs, ids, n = [], [], 0
        if n:
            yield from packed(sigs, ids)

    def inside(batches):
        for b in batches:
            for row in b.to_pylist():
                cols = [_unplaned(row[c]) for c in ("sig", "id", "h1", "h2")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.ones(len(cols[0]), dtype=bool))], schema=whole)

    def across(key, t):
        rows = t.select(["sig", "id", "several"]).to_pylist()
        sig, ids = np.concatenate([_unplaned(x["sig"], 6) for x in rows]), np.concatenate([_unplaned(x["id"]) for x in rows])
        several = np.concatenate([np.unpackbits(np.frombuffer(x["several"], dtype=np.uint8), count=len(x["id"]) // 8) for x in rows]).astype(bool)
        by, of, _, size, h1, h2 = _hubs(sig, ids)
        own = (size > 1)[of]
        by, of = by[own], of[own]
        return pa.table([pa.array(sig[by]), pa.array(ids[by]), pa.array(h1[of]), pa.array(h2[of]), pa.array(~several[by])], schema=whole)

    blocks = scratch.put(first.select("id", "sig").mapInArrow(deal, "bucket int, sig binary, id binary, h1 binary, h2 binary, several binary"))
    lists = blocks.where("bucket < 0").mapInArrow(inside, LISTS).unionByName(blocks.where("bucket >= 0").groupBy("bucket").applyInArrow(across, LISTS))
    lists = scratch.put(lists)
    scratch.drop(blocks)
    return lists


def _unlike(lists: DataFrame) -> DataFrame:
    """sig, id of each list; of lists of the same sets only one."""
    own = lists.where("listed").select("sig", "id")
    sets = own.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), *(F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"ids{k}") for k in range(2)))
    one = sets.groupBy("size", "ids0", "ids1").agg(F.min("sig").alias("sig"))
    return own.join(one.select("sig"), "sig", "left_semi")


def _apart(members: DataFrame, found: DataFrame, traits: DataFrame, scratch: Scratch) -> DataFrame:
    """sig, id, component and traits in those lists of ``members(sig, id)`` whose sets are not all in one component."""
    placed = scratch.put(members.join(found, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component")))
    ends = placed.groupBy("sig").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b").select("sig")
    apart = scratch.put(placed.join(scratch.put(ends), "sig", "left_semi").join(traits, "id"))
    scratch.drop(placed)
    return apart


def _plainest(apart: DataFrame, turn: int) -> DataFrame:
    """The rows of up to HUBS sets of each list: they are dealt at random, and of each deal the one with the fewest rare shingles is taken."""
    lot = F.xxhash64("id", F.lit(turn))
    least = apart.groupBy("sig", F.pmod(lot, F.lit(HUBS)).alias("_deal")).agg(F.min(F.struct("rare", lot.alias("lot"), "id"))["id"].alias("id"))
    return apart.join(least.select("sig", "id"), ["sig", "id"], "left_semi")


def _candidates(apart: DataFrame, hubs: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of a list that are apart and that sizes and parities don't rule out: with hubs, or all."""
    x, y = apart.alias("x"), (apart if hubs is None else hubs).alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    on = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.component") != F.col("y.component")) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & parities_allow("x", "y", percent)
    if hubs is None:
        on = on & (F.col("x.id") < F.col("y.id"))
    return x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are linked."""

    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if ta != last:
                    last, held = ta, shingle_set(ta, k)
                keep.append(linked(held, shingle_set(tb, k), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    second = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = second.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of ``edges(a, b)``: the smallest id that it hangs together with.

    Each round points every node to the neighbour with the most neighbours, ties
    at random, if that is ahead of itself, goes eight steps along those pointers and contracts the edges; the rounds grow with
    the logarithm of the longest path.  Rounds are written tables.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    nodes = scratch.put(both.select(F.col("a").alias("id"), F.col("a").alias("at")).distinct())
    live, turn = scratch.put(both.where("a <> b").distinct()), 0
    while not live.isEmpty():
        degree = live.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
        lot = lambda c, d, turn=turn: F.struct((-F.col(d)).alias("d"), F.xxhash64(c, F.lit(turn)).alias("lot"), F.col(c).alias("id"))
        ahead = live.join(degree.withColumnsRenamed({"a": "b", "d": "e"}), "b").groupBy("a").agg(F.min(lot("b", "e")).alias("_to"))
        up = scratch.put(ahead.join(degree, "a").select("a", F.least("_to", lot("a", "d"))["id"].alias("to")))
        jump = up
        for _ in range(3):  # two, four, eight steps
            jump = jump.join(jump.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select("a", F.col("far").alias("to"))
        jump = scratch.put(jump)
        old_nodes, old_live = nodes, live
        nodes = scratch.put(nodes.join(jump.withColumnRenamed("a", "at"), "at", "left").select("id", F.coalesce("to", "at").alias("at")))
        left = live.join(jump, "a").select(F.col("to").alias("a"), "b")
        right = left.join(jump.withColumnsRenamed({"a": "b", "to": "c"}), "b").select("a", F.col("c").alias("b"))
        live = scratch.put(right.where("a <> b").distinct())
        scratch.drop(old_nodes, old_live, up, jump)
        turn += 1
    least = nodes.groupBy("at").agg(F.min("id").alias("component"))
    return nodes.join(least, "at").select("id", "component")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``.

    Two rows link when ``100 x intersection >= percent x union`` of their
    shingle sets; component_id is the smallest doc_id that links reach.  Texts
    without words (null, blank) link with nothing and are alone.  Rows that
    repeat a doc_id are one document.  Rows without a doc_id have no component
    and take no part.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed = scratch.put(_sets(docs, k, percent, scratch))
    sets = scratch.put(signed.select("doc_id", "n", "digest"))
    classes = scratch.put(sets.where("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").cast("long").alias("id")))
    own = signed.select(F.col("doc_id").cast("long").alias("id"), "n", "digest", "bits", "sig", "rare")
    first = scratch.put(own.join(classes, ["id", "digest", "n"], "left_semi").drop("digest"))
    scratch.drop(signed)
    lists = _lists(first, scratch)
    sketches = scratch.put(first.select("id", "n", "bits", "rare").join(lists.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "n", "bits"]))
    scratch.drop(first)

    def check(pairs: DataFrame) -> DataFrame:
        near = scratch.put(_nearly_link(pairs, sketches, percent))
        named = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = scratch.put(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(named, "id", "left_semi"))
        found = scratch.put(_verify(near, texts, k, percent))
        scratch.drop(near, texts)
        return found

    tried = lists.select("id", F.explode(F.array("h1", "h2")).alias("h")).where("h <> id")
    tried = scratch.put(tried.select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct())
    links = check(tried)
    found = scratch.put(components(links, scratch))

    members, traits = scratch.put(_unlike(lists)), scratch.put(_traits(sketches))
    scratch.drop(lists)
    turn, hubs = 0, True
    while True:
        apart = _apart(members.select("sig", "id"), found, traits, scratch)
        scratch.drop(members)
        pairs = scratch.put(_candidates(apart, _plainest(apart, turn) if hubs else None, percent).join(tried, ["a", "b"], "left_anti"))
        more, members = check(pairs), apart
        if not more.isEmpty():
            links = links.unionByName(more)
            found = scratch.put(components(links, scratch))
        if not hubs:
            break
        tried, turn = tried.unionByName(pairs), turn + 1
        hubs = turn < ROUNDS and 4 * more.count() > pairs.count()  # where few pairs with hubs link, the rest is mostly apart

    reach = classes.select("digest", "n", "id").join(found, "id", "left").select("digest", "n", F.coalesce("component", "id").alias("component"))
    rows = sets.select("doc_id", "n", "digest").join(reach, ["digest", "n"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the smallest doc_id, once.

    Rows without a doc_id or without words stay.  Whole rows are shuffled once, by
    doc_id.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    found = scratch.put(jaccard_components(docs, k, percent))
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)  # alike at every size
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(kept.where("doc_id is null"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the size of its shingle set and its component of links."""
    return jaccard_components(table(spark, sf_dir, "documents"))
