"""Source divergence audit: which sources of a language use its words most unlike each other.

Plain relational: terms are exploded and counted by (lang, source, term); each
group's counts are made dense over the kept vocabulary of its language; a
self-join on (lang, term) gives the differences of sources, and a window ranks.
Integers are exact throughout: shares are floors of decimal quotients.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: A term is a maximal run of ASCII letters and characters beyond ASCII; GAP is what stands between terms.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["lang", "source"]


def lowered(text: Column) -> Column:
    """A-Z in small letters; a text of as many bytes as characters is ASCII, where ``lower`` does the same faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def occurrences(rows: DataFrame) -> DataFrame:
    """(lang, source, term, new) of ``rows(lang, source, text)``: a row with 0 for each occurrence of a term, and one with 1 for each term of a text.

    The matches of TERM are what a split at GAP leaves, but for empty ends.
    """
    # an array of one binds the terms, so that they are found once
    both = F.transform(F.array(F.split(lowered(F.col("text")), GAP, -1)), lambda own: F.array(own, F.array_distinct(own)))[0]
    found = rows.select(*KEY, F.posexplode(both).alias("new", "own"))
    return found.select(*KEY, "new", F.explode("own").alias("term")).where("term <> ''")


def share(count: str, total: str, size: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 size)), in decimals of 38 digits."""
    return F.expr(f"1 + (CAST({count} + 5 AS DECIMAL(25,0)) * 1000000000BD) DIV (CAST({total} AS DECIMAL(25,0)) + 5 * CAST({size} AS DECIMAL(20,0)))")


def dense_counts(groups: DataFrame, kept: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """(lang, source, term, n, lang_n) for every group and kept term of its language.

    A language may hold most of the vocabulary, so terms are dealt to ``salts``
    parts, and groups, which are few beside them, are copied to each part.
    """
    terms = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)))
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    cells = terms.join(copies, ["lang", "salt"]).select("lang", "source", "term", "lang_n")
    return cells.join(counts, [*KEY, "term"], "left").select("lang", "source", "term", F.coalesce("n", F.lit(0)).alias("n"), "lang_n")


def audit_divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs(text, lang, source)``.

    Part ``pair``: the other sources of the language by the summed difference of
    their shares, largest first; part ``term``: the ``top`` terms that a source
    uses more than its language does.  A row is a document, repeated rows too;
    null text, lang and source are ''.  Ties go by the bytes of the item.  A
    language that keeps no term has its pairs with value 0, and one with a single
    source has none.  No rows give no rows.  Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in (*KEY, "text")])
    groups = scratch.put(rows.select(*KEY).distinct())
    counts = scratch.put(occurrences(rows).groupBy(*KEY, "term").agg(F.sum(1 - F.col("new")).alias("n"), F.sum("new").alias("docs")))
    kept = scratch.put(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).drop("docs"))
    cells = scratch.put(dense_counts(groups, kept, counts.drop("docs"), salts))

    sums = cells.groupBy(*KEY).agg(F.sum("n").alias("total"), F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("size"))
    shares = cells.join(scratch.put(sums).hint("merge"), KEY).select(*KEY, "term", "n", share("n", "total", "size").alias("p"), share("lang_n", "lang_total", "size").alias("q"))
    shares = scratch.put(shares)

    a, b = (shares.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("source", "p"), ("item", "q")))
    # the difference of two sources is the same both ways, so it is summed once
    once = a.join(b, ["lang", "term"]).where("source < item").groupBy(*KEY, "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    both = once.select(*KEY, "item", "value", F.explode(F.array(F.lit(False), F.lit(True))).alias("turned"))
    both = both.select("lang", *[F.when(F.col("turned"), F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("source", "item"), ("item", "source"))], "value")
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = others.join(both, [*KEY, "item"], "left").select(*KEY, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = shares.where("n > 0 and p > q").select(*KEY, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    by = Window.partitionBy(*KEY).orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(by)), terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1]).select(*KEY, "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all sources of ``documents``: every pair, and the 50 leading terms of each group."""
    return audit_divergence(table(spark, sf_dir, "documents"))


def op13_sql() -> str:
    share = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * size)"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS text FROM documents),
    t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
    cells AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, lang_n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
    sums AS (SELECT *, sum(n) OVER w AS total, sum(lang_n) OVER w AS lang_total, count(*) OVER w AS size FROM cells WINDOW w AS (PARTITION BY lang, source)),
    shares AS (SELECT lang, source, term, n, {share.format(n="n", total="total")} AS p, {share.format(n="lang_n", total="lang_total")} AS q FROM sums),
    diffs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN diffs ON diffs.lang = a.lang AND diffs.source = a.source AND diffs.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 50"""
