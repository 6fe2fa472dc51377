"""Product-quantised vector codes, exact in integers.

A vector's components become integers; each of its parts takes the nearest entry
of a codebook.  A float32 matrix product screens the entries: each gets an
interval that holds its exact half squared distance less a constant, with all
rounding accounted for, and only entries whose interval reaches below the best
upper end are evaluated again, in int64.  Ties go to the lower index.

Each round is a pass over the vectors: a task sums its parts by entry, and the
sums of all tasks are added by Spark before the few new entries reach the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SCALE, ROWS = 4096, 1 << 14
U = 2.0**-24  # unit roundoff of float32


def screen(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries (columns) may be nearest to each row of integers ``v``.

    The score |c|^2 / 2 - v.c orders entries as squared distance does.  Integers
    are rounded to float32 (u each), products are summed in any order (d terms),
    the half square is rounded and subtracted (2 u): together the error is below
    (d + 5) u / (1 - (d + 5) u) times (|v| |c| + |c|^2 / 2), by Cauchy-Schwarz.
    """
    d = v.shape[1]
    half = (entries * entries).sum(axis=1) / 2
    score = (half.astype(np.float32) - v.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    gamma = (d + 5) * U / (1 - (d + 5) * U) * (1 + 1e-9)  # what float64 loses below
    off = gamma * (np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(2 * half) + half)
    return score - off <= (score + off).min(axis=1, keepdims=True)


def nearest_entries(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of int64 ``v``; exact, ties to the lower index."""
    row, entry = np.nonzero(screen(v, entries))
    exact = ((v[row] - entries[entry]) ** 2).sum(axis=1)
    by = np.lexsort((entry, exact, row))
    first = by[np.concatenate(([True], row[by][1:] != row[by][:-1]))] if len(by) else by
    return entry[first], exact[first]


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, size)


def _blocks(batches, at: int, size: int):
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            own = b.slice(i, ROWS)
            yield own, _matrix(own.column(at), size)


def integer_vectors(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, ``v`` in integers, and the length of all ``v``."""
    x = F.col("embedding")
    fine = rows.select("vec_id", "label", "embedding").where("embedding is not null").where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    usual = fine.groupBy(F.size("embedding").alias("d")).count().where(f"d > 0 and d % {parts} = 0").orderBy(F.desc("count"), "d").first()
    size = usual["d"] if usual else parts
    most = math.isqrt((1 << 61) // size)  # so that squared distances summed over a vector fit a long
    small = F.forall(x, lambda e: F.abs(e.cast("double")) < most / SCALE)
    return fine.where(F.size("embedding") == size).where(small).select("vec_id", "label", F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v")), size


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Parts x entries x components from the vectors of the smallest ids."""
    least = vectors.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    return np.array([r["v"] for r in least], dtype=np.int64).reshape(len(least), parts, len(least[0]["v"]) // parts if least else 0).transpose(1, 0, 2)


def next_codebooks(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floors of the means of the parts that are nearest to them."""
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for _, v in _blocks(batches, 0, parts * width):
            for p in range(parts):
                own = v[:, p * width : (p + 1) * width]
                code, _ = nearest_entries(own, books[p])
                for c in np.unique(code):
                    total[p, c] += own[code == c].sum(axis=0)
                count[p] += np.bincount(code, minlength=entries)
        p, c = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(count[p, c], pa.int64()), pa.array(list(total[p, c]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    each = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<bigint>")
    added = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # a row for each entry
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def compress_vectors(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of the vectors that take part, and the codebooks (parts x entries x components).

    Vectors that are null or hold null or non-finite components take no part; nor
    do those whose length is not the commonest that ``parts`` divides, or whose
    squared distances would not fit a long (with 64 components, from 46,340 on).
    Repeated rows all count; ids that repeat give one first entry, of the least
    vector; a null id comes after all others.  Fewer ids than ``entries`` give as
    many entries, no rows none.  Other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession, "codes")
    vectors, _ = integer_vectors(rows, parts)
    vectors = scratch.put(vectors)
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = next_codebooks(vectors, books)
    width = books.shape[2] if books.size else 0

    def assign(batches):
        for b, v in _blocks(batches, 2, parts * width):
            got = [nearest_entries(v[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code = np.stack([c for c, _ in got], axis=1).astype(np.uint8)
            error = sum(e for _, e in got)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    coded = vectors.mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    return scratch.put(coded), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels, nulls together; null where the sum leaves a long.

    The sums are a table of their own, so a label of most rows can be split in the join.
    """
    sums = Scratch(coded.sparkSession, "codes").put(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")))
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector of ``embeddings``, with the digest of the codebooks."""
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds unrolled; a step's tables are named by its number."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT id, vec_id, label, part, x, min(struct_pack(d := d, e := entry)) AS best
        FROM (SELECT p.*, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut p JOIN book{k} USING (part)) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM (SELECT part, best.e AS entry, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
        FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM cut) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
        book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""")
    body = ",\n    ".join(steps)
    return f"""
    WITH kept AS (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    cut AS MATERIALIZED (SELECT id, vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS part)),
    book0 AS MATERIALIZED (SELECT part, x AS c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
    {body},
    coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e::INTEGER), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY id, vec_id, label),
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, digest"""
