"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt in equal blocks.  Each block goes to the source with the
highest quotient ``target / (2 k - 1)``; inside a source the blocks go to its
shards (hash cells of documents) the same way.  A shard's documents are laid end
to end in an order that the seed draws, and cut into blocks; its quota are the
first blocks of that order, after as many whole passes as the quota holds.  So a
seeded draw of blocks is told by one place a shard: where the quota ends.

Everything is DataFrame expressions.  Texts are never shuffled: windows see
(lot, size) of documents, and a document's share follows from its own lot and the
place where its shard's quota ends.  No table that is gathered in a window grows
with the documents faster than one row for a source, or 65,536 rows for the
shards of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, word_count

#: Hash cells of a source.  Shards are runs of cells, so there are at most so many.
CELLS = 65536


def apportion(votes: DataFrame, by: list[str], key: str, vote: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague seats of each row of ``votes`` inside each group ``by``.

    ``seats`` holds the group's number of seats.  With S rows and M seats the
    divisor method gives a row at least ``q (1 - S/2M) - 1/2`` and at most
    ``q (1 + S/2M) + 1/2`` of its quota q, so only that many quotients a row are
    ranked, about 3 S in all.  Ties go to the smaller ``key``.
    """
    w = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    q = F.col(vote) / F.col("_votes") * F.col(seats)
    slack = F.col("_n") / (2 * F.col(seats))
    some = (F.col(vote) > 0) & (F.col(seats) > 0)
    sized = (
        votes.withColumns({"_votes": F.sum(vote).over(w), "_n": F.count(F.lit(1)).over(w)})
        .withColumn("_lo", F.when(some, F.greatest(F.lit(0), F.ceil(q * (1 - slack) - 0.5) - 1)).otherwise(0).cast("long"))
        .withColumn("_hi", F.when(some, F.floor(q * (1 + slack) + 0.5) + 1).otherwise(0).cast("long"))
        .withColumn("_rest", F.col(seats) - F.sum("_lo").over(w))
    )
    ranked = (
        sized.where("_hi > _lo")
        .select(*by, key, "_rest", F.col(vote).alias("_v"), F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_k"))
        .withColumn("_rank", F.row_number().over(w.orderBy((F.col("_v") / (2 * F.col("_k") - 1)).desc(), key, "_k")))
        .where("_rank <= _rest")
        .groupBy(*by, key)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        sized.join(ranked, [*by, key], "left")
        .withColumn(out, F.col("_lo") + F.coalesce("_won", F.lit(0)))
        .drop("_votes", "_n", "_lo", "_hi", "_rest", "_won")
    )


def fill_targets(sources: DataFrame, weights: tuple[float, ...], share: float, repeat: float) -> DataFrame:
    """``target`` of each source: weighted shares of ``share`` x all words, none above ``repeat`` x its own.

    With the sources in order of cap / weight, the level that fills to the brim
    is the largest of (rest of words) / (rest of weights).
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "key")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    return (
        sources.withColumn("weight", weight)
        .withColumn("_cap", F.col("source_size") * float(repeat))
        .withColumn("_all", F.sum("source_size").over(every) * float(share))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("target", F.least("_cap", F.col("weight") * F.max("_level").over(every)))
        .drop("_cap", "_all", "_level")
    )


def _lots(docs: DataFrame, seed: int) -> list:
    """Key of the source, lot and size of each row, under names that no caller uses."""
    lot = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))
    return [F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_key"), lot.alias("_lot"), word_count("text").alias("_size")]


def _cell(lot: str) -> Column:
    return F.shiftrightunsigned(lot, 48)


def quotas(rows: DataFrame, scratch: Scratch, weights: tuple, share: float, repeat: float, block_words: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """(sources, shards) of ``rows(_key, source, _lot, _size)``, both under names that begin with an underscore.

    Sources have their size, target, block, quota and number of shards.  Shards have
    _passes (whole passes through all documents), _end (the lot at which the rest
    of the quota ends), and _part of _whole: which share of the words at that lot
    is taken.
    """
    cells = scratch.put(rows.groupBy(F.col("_key").alias("key"), _cell("_lot").alias("cell")).agg(F.sum("_size").alias("size"), F.first("source").alias("source")))
    sources = fill_targets(cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, share, repeat)
    every = Window.partitionBy(F.lit(0))
    sources = (
        sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / 256))))
        .withColumn("block", F.coalesce("block", F.lit(1)).cast("long"))
        .withColumn("_seats", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
    )
    sources = apportion(sources, [], "key", "target", "_seats", "quota").withColumn(
        "shards", F.least(F.lit(CELLS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long")
    )
    sources = scratch.put(sources.select("key", "source_size", "target", "block", "quota", "shards"))

    shard = F.floor(F.col("cell") * F.col("shards") / CELLS).cast("long")
    shards = cells.join(sources, "key").withColumn("shard", shard).groupBy("key", "shard", "quota", "block").agg(F.sum("size").alias("words"))
    take = F.least(F.col("blocks") * F.col("block"), F.col("words") * repeat).cast("long")
    shards = apportion(shards, ["key"], "shard", "words", "quota", "blocks").select("key", "shard", "words", take.alias("take"))
    passes = F.expr("coalesce(take div nullif(words, 0), 0)")
    shards = scratch.put(shards.select("key", "shard", passes.alias("passes"), (F.col("take") - passes * F.col("words")).alias("rest")))

    of = Window.partitionBy("key", "shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lots = rows.groupBy(F.col("_key").alias("key"), F.col("_lot").alias("lot")).agg(F.sum("_size").alias("words")).withColumn("cell", _cell("lot"))
    ends = (
        lots.join(sources.select("key", "shards"), "key")
        .withColumn("shard", shard)
        .withColumn("upto", F.sum("words").over(of))
        .join(shards.where("rest > 0"), ["key", "shard"])
        .where("upto >= rest and upto - words < rest")
        .select("key", "shard", "lot", "words", (F.col("rest") - F.col("upto") + F.col("words")).alias("part"))
    )
    shards = shards.join(ends, ["key", "shard"], "left").select(F.col("key").alias("_key"), F.col("shard").alias("_shard"), F.col("passes").alias("_passes"), F.col("lot").alias("_end"), F.col("part").alias("_part"), F.col("words").alias("_whole"))
    return sources.select(F.col("key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "block", "quota", "shards")]), scratch.put(shards)


#: Rows up to which the table of sources or of shards is broadcast (at some 60 bytes a row); a larger one is joined as Spark finds best.
SMALL = 1 << 18


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def dealt(docs: DataFrame, keep: list, weights, share, repeat, seed, block_words, shard_words) -> DataFrame:
    """``keep`` (columns of ``docs``), the source's and the shard's figures, and _taken of each row; no row is moved."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select("source", *_lots(docs, seed))
    sources, shards = quotas(scratch.put(rows), scratch, weights, share, repeat, block_words, shard_words)
    ahead = F.when(F.col("_lot") < F.col("_end"), F.col("_size")).when(F.col("_lot") == F.col("_end"), F.floor(F.col("_size") * F.col("_part") / F.col("_whole")))
    return (
        docs.select(*keep, *_lots(docs, seed))
        .join(_small(sources), "_key")
        .withColumn("_shard", F.floor(_cell("_lot") * F.col("_shards") / CELLS).cast("long"))
        .join(_small(shards), ["_key", "_shard"])
        .withColumn("_taken", (F.col("_passes") * F.col("_size") + F.coalesce(ahead, F.lit(0))).cast("long"))
    )


def mix(
    docs: DataFrame,
    keep: list[str],
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    repeat: int = 2,
    seed: int = 17,
    block_words: int = 1024,
    shard_words: int = 1 << 18,
) -> DataFrame:
    """Words that a mix of all sources takes from each row of ``docs(doc_id, text, source)``.

    Returns the columns ``keep`` with size, source_size, target, quota (blocks
    of the document's source), shard and taken, which replace columns of ``keep``
    with their names.  Sources in code point order, null last, get ``weights`` in
    turn.  A block has ``block_words`` words, or fewer so that the smallest target
    has 256 of them.

    Null or blank texts have size 0 and take 0.  A null source is a source, a null
    doc_id an id.  Rows with the same doc_id and text share what is taken of them
    evenly, rounded down.  An empty table gives no rows.
    """
    added = ("size", "source_size", "target", "quota", "shard", "taken")
    kept = [c for c in keep if c not in added]
    got = dealt(docs, [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)], weights, share, repeat, seed, block_words, shard_words)
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"_{c}").alias(c) for c in added])


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2, seed: int = 17, block_words: int = 1024, shard_words: int = 1 << 18) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each as often as the mix takes it, halves rounded up.

    A document without words takes none of the mix, and stays once.
    """
    names = docs.columns
    got = dealt(docs, [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)], weights, share, repeat, seed, block_words, shard_words)
    times = F.expr("if(_size = 0, 1, cast(round(_taken / _size) as int))")
    return (
        got.withColumn("_times", times)
        .where("_times > 0")
        .select(*[f"c{i}" for i in range(len(names))], F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
        .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "quota", "shard", "taken")
