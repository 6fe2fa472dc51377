"""Sharding by vector bin packing over bytes, tokens and rows.

Groups of equal texts are the items.  A group above 1/4096 of all bytes or rows
is an item of its own (there are at most 8192 such); the rest share 4096 hash
cells.  A group that would fill half a shard is split by a hash of doc_id into
pieces.  So the greedy pass sees a bounded number of items at any scale, and
each item goes to the shard whose residual capacity has the highest dot product
with it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, word_count

#: Hash cells for the small groups, and the share from which a group stands alone.
CELLS = 4096
#: Weights of bytes, tokens and rows in the dot product; bytes are the law.
IMPORTANCE = (6.0, 1.0, 1.0)


def greedy(vectors: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each row of ``vectors`` (shares of the whole, one column a dimension), the largest first."""
    placed = np.zeros(len(vectors), dtype=np.int64)
    rest = np.full((bins, vectors.shape[1]), 1.0 / bins)
    weight = np.array(IMPORTANCE[: vectors.shape[1]])
    for i in np.lexsort((np.arange(len(vectors)), -vectors[:, 0], -vectors.max(axis=1))):
        at = int(np.argmax(rest @ (vectors[i] * weight)))
        placed[i] = at
        rest[at] -= vectors[i]
    return placed


def stats(docs: DataFrame, keep: list) -> DataFrame:
    """``keep`` with the group key and the three sizes of each row."""
    return docs.select(
        *keep,
        F.xxhash64("text").alias("_group"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        word_count("text").alias("tokens"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit("piece")), F.lit(1 << 30)).alias("_draw"),
    )


def pack(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(large groups with their number of pieces, shard of each item).

    Both are of bounded size: at most 2 x CELLS groups, and 3 x CELLS items with
    the pieces, which is why they may be collected and broadcast.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    size, tokens, n = (max(1, x or 0) for x in (total["size"], total["tokens"], total["n"]))
    groups = rows.groupBy("_group").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"))
    part = F.greatest(F.col("b") / size, F.col("r") / n)
    large = groups.where(part * CELLS > 1).select("_group", F.when(part > 0.5 / shards, F.ceil(part * 16 * shards)).otherwise(1).cast("int").alias("_pieces"))
    large = spark.createDataFrame([tuple(x) for x in large.collect()], "_group long, _pieces int")
    items = itemized(rows, large).groupBy("_item").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    found = sorted(tuple(x) for x in items.collect())
    if found:
        placed = greedy(np.array([x[1:] for x in found], dtype=float) / (size, tokens, n), shards)
    return large, spark.createDataFrame([(x[0], int(at)) for x, at in zip(found, placed, strict=True)] if found else [], "_item string, shard int")


def itemized(rows: DataFrame, large: DataFrame) -> DataFrame:
    own = F.concat_ws(":", F.lit("g"), F.col("_group").cast("string"), F.pmod(F.col("_draw"), F.col("_pieces")).cast("string"))
    cell = F.concat(F.lit("c"), F.pmod(F.col("_group"), F.lit(CELLS)).cast("string"))
    return rows.join(F.broadcast(large), "_group", "left").withColumn("_item", F.when(F.col("_pieces").isNotNull(), own).otherwise(cell)).drop("_pieces")


def shard_rows(docs: DataFrame, keep: list[str], shards: int = 16) -> DataFrame:
    """``keep`` and size, text_crc32, tokens, shard of every row, which replace columns of ``keep`` with their names; no row is moved.

    A null text counts as one byte and groups with other nulls.  Equal texts
    share a shard unless their group would fill half of one.  An empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    added = ("size", "text_crc32", "tokens", "shard")
    kept = [c for c in keep if c not in added]
    narrow = scratch.put(stats(docs, []))
    large, placed = pack(narrow, shards)
    scratch.drop(narrow)
    rows = itemized(stats(docs, [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)]), large).join(F.broadcast(placed), "_item")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *added)


def with_slots(rows: DataFrame, run: int = 20000) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, without sorting a whole shard in one task.

    Rows are numbered inside hash runs of about ``run`` rows; a run starts where
    the runs before it end.
    """
    scratch = Scratch(rows.sparkSession, "slots")
    runs = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    runs = runs // run + 1
    rows = scratch.put(rows.withColumn("_run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs))))
    sizes = rows.groupBy("shard", "_run").agg(F.count(F.lit(1)).alias("_n"))
    start = F.sum("_n").over(Window.partitionBy("shard").orderBy("_run")) - F.col("_n")
    at = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("_at", at).join(sizes.select("shard", "_run", start.alias("_start")), ["shard", "_run"]).withColumn("slot", (F.col("_start") + F.col("_at") - 1).cast("long")).drop("_run", "_at", "_start")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its shard out of 16 of near equal bytes, and its place there."""
    rows = with_slots(shard_rows(table(spark, sf_dir, "documents"), ["doc_id"]))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
