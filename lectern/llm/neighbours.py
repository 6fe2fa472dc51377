"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one a shard.

Vectors are dealt to shards of bounded size by a hash.  A shard's graph is built
in batches: greedy beam searches propose neighbours, and relaxed distance
pruning keeps diverse edges in both directions.  Nodes that pruning leaves
without ways in get some back, and each graph measures how wide a beam its
vectors ask for.  Every query is beam-searched in
every shard; the best of all shards are re-scored in double precision.  For the
graph, vectors get one more component that makes all norms equal, so that
distance and inner product agree in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, width: int, stride: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, closeness) of the ``width`` best found for each row of q, best first; -1 where fewer are reached.

    All queries go in step; each step expands the best ``stride`` nodes not yet expanded of every query.
    """
    m, n = len(q), len(x)
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, n] = True
    row = np.arange(m)[:, None]
    node = np.full((m, width), n, dtype=np.int64)
    near = np.full((m, width), -np.inf, dtype=np.float32)
    done = np.ones((m, width), dtype=bool)
    node[:, 0], near[:, 0], done[:, 0] = entry, q @ x[entry], False
    seen[:, entry] = True
    live = np.arange(m)
    while len(live):
        r = np.arange(len(live))[:, None]
        open_ = np.where(done[live], -np.inf, near[live])
        pick = np.argpartition(-open_, min(stride, width - 1), axis=1)[:, :stride]
        usable = np.isfinite(open_[r, pick])
        done[live[:, None], pick] = True
        own = np.where(usable, node[live[:, None], pick], n)
        new = edges[own].reshape(len(live), -1)
        new = np.where(seen[live[:, None], new], n, new)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        seen[live[:, None], new] = True
        score = np.einsum("brd,bd->br", x[np.minimum(new, n - 1)], q[live])
        score[new == n] = -np.inf
        all_near = np.concatenate([near[live], score], axis=1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        near[live] = all_near[r, best]
        node[live] = np.concatenate([node[live], new], axis=1)[r, best]
        done[live] = np.concatenate([done[live], np.zeros(new.shape, dtype=bool)], axis=1)[r, best]
        live = live[(~done[live] & np.isfinite(near[live])).any(axis=1)]
    order = np.argsort(-near, axis=1, kind="stable")
    near = near[row, order]
    return np.where(np.isfinite(near), node[row, order], -1), near


def robust_prune(x: np.ndarray, base: np.ndarray, cands: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each base node out of its candidates (n marks none)."""
    n, norm = len(x), float(x[0] @ x[0])
    cands = np.where(cands == base[:, None], n, cands)
    cands.sort(axis=1)
    cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = n
    v = x[np.minimum(cands, n - 1)]
    away = 2 * norm - 2 * np.einsum("bkd,bd->bk", v, x[base])
    away[cands == n] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    row = np.arange(len(base))[:, None]
    cands, away, v = cands[row, order], away[row, order], v[row, order]
    between = 2 * norm - 2 * (v @ v.transpose(0, 2, 1))
    alive = np.isfinite(away)
    out = np.full((len(base), degree), n, dtype=np.int64)
    r = np.arange(len(base))
    for i in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        out[some, i] = cands[r, at][some]
        alive &= alpha * alpha * between[r, at] > away
        alive[r, at] = False
    return out


def build_graph(x: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2, batch: int = 256, seed: int = 5) -> tuple[np.ndarray, int]:
    """(edges, entry) over rows of equal norm; edges has a last row for the mark ``n`` of no node."""
    n = len(x)
    edges = np.full((n + 1, degree), n, dtype=np.int64)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    start = 1
    while start < n:
        own = order[start : start + min(batch, start)]
        start += len(own)
        found, _ = beam_search(x, edges, entry, x[own], width)
        cands = np.concatenate([np.where(found < 0, n, found), edges[own]], axis=1)
        if len(own) <= 64:  # the first batches also see each other
            cands = np.concatenate([cands, np.broadcast_to(own, (len(own), len(own)))], axis=1)
        edges[own] = robust_prune(x, own, cands, degree, alpha)
        src, dst = np.repeat(own, degree), edges[own].ravel()
        src, dst = src[dst < n], dst[dst < n]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, first, count = np.unique(dst, return_index=True, return_counts=True)
        slots = np.arange(len(dst)) - np.repeat(first, count)
        incoming = np.full((len(heads), int(count.max(initial=1))), n, dtype=np.int64)
        incoming[np.repeat(np.arange(len(heads)), count), slots] = src
        cands = np.concatenate([edges[heads], incoming], axis=1)
        cands.sort(axis=1)
        dup = np.zeros(cands.shape, dtype=bool)
        dup[:, 1:] = cands[:, 1:] == cands[:, :-1]
        cands[dup] = n
        cands.sort(axis=1)
        room = (cands < n).sum(axis=1) <= degree
        edges[heads[room]] = cands[room][:, :degree]
        for i in range(0, int((~room).sum()), batch):
            some = np.flatnonzero(~room)[i : i + batch]
            edges[heads[some]] = robust_prune(x, heads[some], cands[some][:, : int((cands[some] < n).sum(axis=1).max())], degree, alpha)
    return edges, entry


def stride_of(width: int) -> int:
    """Nodes that a step of a search expands: some forty steps, whatever the width."""
    return max(4, width // 40)


def width_for(x: np.ndarray, edges: np.ndarray, entry: int, k: int, width: int, recall: float, asked: int = 64, seed: int = 9) -> int:
    """The beam that finds ``recall`` of the ``k`` nearest of ``asked`` drawn nodes, measured against all nodes of the graph.

    It starts at ``width`` and doubles; a beam of all nodes is the widest.
    """
    n = len(x)
    q = x[np.random.default_rng(seed).choice(n, min(asked, n), replace=False)].copy()
    q[:, -1] = 0  # as queries are put
    near = np.partition(q @ x.T, n - min(k, n), axis=1)[:, n - min(k, n)]
    while width < n:
        _, found = beam_search(x, edges, entry, q, width, stride_of(width))
        if (found[:, :k] >= near[:, None] * (1 - 1e-6 * np.sign(near[:, None]))).mean() >= recall:
            break
        width *= 2
    return min(width, n)


def reached(edges: np.ndarray, entry: int) -> np.ndarray:
    """Whether each node can be reached from the entry; the mark of no node counts as reached."""
    n = len(edges) - 1
    seen = np.zeros(n + 1, dtype=bool)
    seen[[entry, n]] = True
    front = np.array([entry])
    while len(front):
        front = np.unique(edges[front])
        front = front[~seen[front]]
        seen[front] = True
    return seen


def _added(extra: np.ndarray, used: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> None:
    """Fills free places of ``extra`` with edges, as many as fit, in the order given."""
    by = np.argsort(heads, kind="stable")
    heads, tails = heads[by], tails[by]
    first = np.concatenate(([True], heads[1:] != heads[:-1]))
    slot = np.arange(len(heads)) - np.flatnonzero(first)[np.cumsum(first) - 1] + used[heads]
    fits = slot < extra.shape[1]
    extra[heads[fits], slot[fits]] = tails[fits]
    np.add.at(used, heads[fits], 1)


def with_ways_in(edges: np.ndarray, entry: int, least: int = 16, room: int = 32) -> np.ndarray:
    """``edges`` with up to ``room`` more of each node, so that every node can be reached.

    Where pruning takes the edges to a node that is no one's nearest, its own
    neighbours get one back, the rarest first, until it has ``least`` of them.
    Nodes still out of reach are hung behind nodes in reach.
    """
    n, degree = len(edges) - 1, edges.shape[1]
    into = np.bincount(edges[:n].ravel(), minlength=n + 1)
    u, p = np.repeat(np.arange(n), degree), edges[:n].ravel()
    rank = np.tile(np.arange(degree), n)
    some = (p < n) & (into[u] + rank < least)
    u, p, rank = u[some], p[some], rank[some]
    known = np.isin(p * (n + 1) + u, (np.arange(n)[:, None] * (n + 1) + edges[:n]).ravel())
    u, p, rank = u[~known], p[~known], rank[~known]
    by = np.lexsort((rank, into[u]))
    extra, used = np.full((n + 1, room), n, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    _added(extra, used, p[by], u[by])
    while True:
        whole = np.concatenate([edges, extra], axis=1)
        seen = reached(whole, entry)
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return whole
        free = np.flatnonzero(seen[:n] & (used[:n] < room))
        if not len(free):  # all nodes in reach are full: one more place each
            extra = np.concatenate([extra, np.full((n + 1, room), n, dtype=np.int64)], axis=1)
            room *= 2
            continue
        near = np.where(seen[edges[lost]] & (edges[lost] < n) & (used[edges[lost]] < room), edges[lost], n).min(axis=1)
        _added(extra, used, np.where(near < n, near, free[np.arange(len(lost)) % len(free)]), lost)


def equal_norms(v: np.ndarray) -> np.ndarray:
    """float32 rows with one more component, so that all have the largest norm."""
    v = v.astype(np.float64)
    v = v / max(np.abs(v).max(), 1e-300)
    sq = (v * v).sum(axis=1)
    top = np.sqrt(sq.max())
    return np.concatenate([v / top, np.sqrt(np.maximum(0, 1 - sq / sq.max()))[:, None]], axis=1).astype(np.float32)


def usable_vectors(rows: DataFrame) -> DataFrame:
    """Distinct (id, v) of ``rows(vec_id, embedding)`` that take part: whole, finite, not zero, of the commonest length."""
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    some = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null").where(fine)
    sizes = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return some.where(F.size("v") == (sizes["d"] if sizes else 0)).distinct()


def nearest(rows: DataFrame, queries: str, k: int = 20, shard_rows: int = 32768, degree: int = 32, width: int = 64, search: int = 160, alpha: float = 1.2, lot: int = 1 << 16, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row where ``queries`` (SQL over ``id``) holds.

    Vectors that are null, zero, of another length, or hold null or non-finite
    components take no part; nor do rows without an id.  Repeated rows count
    once.  Equal vectors share a node, which keeps their smallest ids: enough
    for any answer, as ties go to the smaller id.  With fewer candidates than
    ``k`` all are returned.  An id that stands for several vectors asks with
    each, and its answers are ranked together.

    ``search`` is the narrowest beam.  Each graph measures, on 64 of its nodes
    against all of them, how wide a beam finds ``recall`` of the nearest, and is
    searched with that: clustered vectors need narrow beams, vectors without any
    structure wide ones.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "neighbours")
    vectors = scratch.put(usable_vectors(rows))
    n, asked = vectors.count(), vectors.where(queries).count()
    shards, lots = max(1, -(-n // shard_rows)), max(1, -(-asked // lot))
    graph = "shard int, vectors binary, ids binary, first binary, edges binary, entry int, width int"

    def build(t):
        v = np.array(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1)
        ids = np.array(t.column("id"), dtype=np.int64)
        by = np.lexsort((ids, *v.T[::-1]))
        v, ids = v[by], ids[by]
        new = np.concatenate(([True], (v[1:] != v[:-1]).any(axis=1)))
        first = np.flatnonzero(new)
        among = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        ids, group = ids[among <= k], (np.cumsum(new) - 1)[among <= k]
        x = equal_norms(v[first])
        edges, entry = build_graph(x, degree, width, alpha)
        edges = with_ways_in(edges, entry)
        beam = width_for(x, edges, entry, k, search, recall)
        first_of = np.searchsorted(group, np.arange(len(first) + 1))
        cells = [v[first].tobytes(), ids.tobytes(), first_of.astype(np.int64).tobytes(), edges.astype(np.int32).tobytes()]
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(("vectors", "ids", "first", "edges"), cells, strict=True)}, "entry": pa.array([entry], pa.int32()), "width": pa.array([beam], pa.int32())})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = scratch.put(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(build, graph))

    found = "query_id long, ids array<bigint>, scores array<double>"

    def ask(g, q):
        out = ([], [], [])
        if g.num_rows and q.num_rows:
            cell = {c: g.column(c)[0].as_py() for c in g.column_names}
            wanted = np.array(q.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(q.num_rows, -1)
            v = np.frombuffer(cell["vectors"], dtype=np.float64).reshape(-1, wanted.shape[1])
            ids, first = np.frombuffer(cell["ids"], dtype=np.int64), np.frombuffer(cell["first"], dtype=np.int64)
            edges = np.frombuffer(cell["edges"], dtype=np.int32).reshape(len(v) + 1, -1).astype(np.int64)
            x = equal_norms(v)
            names = q.column("id").to_pylist()
            for i in range(0, len(names), 256):
                own = wanted[i : i + 256]
                flat = np.concatenate([own / np.abs(own).max(axis=1, keepdims=True), np.zeros((len(own), 1))], axis=1).astype(np.float32)
                nodes, _ = beam_search(x, edges, cell["entry"], flat, cell["width"], stride_of(cell["width"]))
                for name, vec, at in zip(names[i : i + 256], own, nodes, strict=True):
                    at = at[at >= 0]
                    score = v[at] @ vec
                    size = first[at + 1] - first[at]
                    member = np.concatenate([ids[first[a] : first[a + 1]] for a in at])
                    score = np.repeat(score, size)
                    score, member = score[member != name], member[member != name]
                    best = np.lexsort((member, -score))[:k]
                    for o, val in zip(out, (name, member[best].tolist(), score[best].tolist()), strict=True):
                        o.append(val)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.list_(pa.int64())), "scores": pa.array(out[2], pa.list_(pa.float64()))})

    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    wanted = vectors.where(queries).withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int")).select("lot", "id", "v", every.alias("shard"))
    copies = graphs.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    hits = copies.groupBy("shard", "lot").cogroup(wanted.groupBy("shard", "lot")).applyInArrow(ask, found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
        .select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
