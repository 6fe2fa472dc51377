"""Objective scores of documents: five parts of 60 points in one pass over each text, and what they recommend."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import Pack
from . import structure as S
from .matching import Lexicon, once
from .rewriting import dictionary_pattern

DASH = "——|—|--+"


def route(total: Column) -> Column:
    """Flow of an objective score of 60."""
    return F.when(total >= 40, "fast").when(total >= 30, "full").otherwise("rewrite")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def densities(text: Column, pack: Pack, words: tuple, size: int = 500) -> Column:
    """Information of each whole segment: quotes and verbs (as tokens of maximum matching) for each letter; segments without letters, and texts with fewer than ``size`` letters and marks, have none.

    A text is cut once inside one function; an argument must be a column of its own.
    """
    tokens, quotes, letters = (re.compile(p) for p in (dictionary_pattern([*words, *pack.verbs]), pack.quotes, f"(?:{pack.letters})+"))
    counted, verbs = re.compile(f"(?:{pack.letters}|{pack.marks})+"), frozenset(pack.verbs)
    length = lambda p, s: sum(map(len, p.findall(s)))

    def each(t: str | None) -> list[float]:
        if not t or len(t) < size or length(counted, t) < size:
            return []
        out = []
        for i in range(0, len(t) - size + 1, size):
            s = t[i : i + size]
            if n := length(letters, s):
                out.append((len(quotes.findall(s)) + sum(w in verbs for w in tokens.findall(s))) / n)
        return out

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([each(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return once(of, "array<double>")(text)


def senses(narrative: Column, pack: Pack) -> Column:
    """Number of senses that a text names, by longest matches; excluded compounds are consumed."""
    words = {w: k for k, ws in pack.senses.items() for w in ws}
    terms = sorted({*words, *pack.sense_excludes}, key=lambda w: (-len(w), w))
    lookup = F.create_map(*[F.lit(x) for w, k in words.items() if w not in pack.sense_excludes for x in (w, k)])
    kinds = F.transform(Lexicon({"": terms}).kinds(narrative), lambda w: F.try_element_at(lookup, w))
    return F.size(F.array_distinct(F.filter(kinds, lambda k: k.isNotNull())))


def features(docs: DataFrame, pack: Pack, words: tuple = ()) -> DataFrame:
    """doc_id and what the scores ask of a text's prose: densities, sentence lengths, senses, similes, blocking marks."""
    seen = lambda x: T.visible_length(x, pack.visible)
    counts = F.filter(S.prose(F.coalesce("text", F.lit(""))), lambda x: (x["line"] != "") & ~T.is_divider(x["line"]) & ~T.is_structural(x["line"]))
    pairs = F.transform(counts, lambda x: F.struct(x["line"].alias("line"), T.strip_quoted(x["line"]).alias("told")))
    rows = docs.select("doc_id", pairs.alias("_l"))
    own = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)  # noqa: E731  stays a column, as an argument of a function
    rows = rows.select("doc_id", own(F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("full"), own(F.filter("_l", lambda x: seen(x["told"]) > 0)).alias("_l"))
    rows = rows.select("doc_id", "full", "_l", own(F.array_join(F.transform("_l", lambda x: x["told"]), "")).alias("told"))
    rows = rows.select("doc_id", "_l", "told", densities(F.col("full"), pack, words).alias("dens"), senses(F.col("told"), pack).alias("senses"))
    lengths = F.flatten(F.transform("_l", lambda x: F.transform(T.sentences(x["told"], pack.ends), seen)))
    of = lambda patterns, x: sum((T.count_matches(x, p) for p in patterns), F.lit(0).cast("long"))
    blocking = _count(F.transform("_l", lambda x: of(pack.blocking, x["told"]) + T.count_terms(x["told"], pack.lists["ban_a"])))
    return rows.select(
        "doc_id", "dens", F.filter(lengths, lambda n: n > 0).alias("lengths"), seen("told").alias("chars"), "senses",
        of(pack.similes, F.col("told")).alias("similes"), _count(F.transform("_l", lambda x: of(pack.similes, x["told"]))).alias("line_similes"), blocking.alias("blocking"), _count(F.transform("_l", lambda x: T.count_matches(x["line"], DASH))).alias("dashes"),
    )


def _plot(dens: Column) -> Column:
    """Out of 15: mean density, thin segments, and segments that hardly vary."""
    mean = _sum(dens) / F.nullif(F.size(dens), F.lit(0))
    low = F.size(F.filter(dens, lambda x: x < 0.02))

    def of(m: Column) -> Column:
        variance = _sum(F.transform(dens, lambda x: (x - m) * (x - m))) / F.size(dens)
        by_mean = F.when(m >= 0.08, 0).when(m >= 0.05, 2).when(m >= 0.03, 5).otherwise(8)
        return 15 - by_mean - F.least(2 * low, F.lit(5)) - F.when((F.size(dens) >= 3) & (variance < 0.002), 2).otherwise(0)

    return T.let(F.coalesce(mean, F.lit(0.0)), of)


def _by_issues(n: Column) -> Column:
    return F.when(n == 0, 10).when(n <= 2, 7).when(n <= 5, 3).otherwise(0)


def objective_scores(docs: DataFrame, pack: Pack, words: tuple = (), issues: DataFrame | None = None) -> DataFrame:
    """doc_id, plot, rhythm, texture, consistency, baseline, total, flow of each document.

    ``words`` is the dictionary that keeps verbs inside longer words from
    counting.  ``issues(doc_id, issues)`` counts contradictions of documents; one
    without a row there has none, and without the table consistency is 7.
    """
    rows = features(docs, pack, words)
    n, mean, cv = S.spread(F.col("lengths"))
    rows = rows.select("*", n.alias("_n"), cv.alias("_cv"), (cv * mean).alias("_std"))
    rhythm = F.when(F.col("_n") < 5, 5).otherwise(15 - F.when(F.col("_cv") >= 0.5, 0).when(F.col("_cv") >= 0.3, 5).otherwise(10) - F.when(F.col("_std") < 8, 3).otherwise(0))
    density = lambda c: F.col(c) * 1000.0 / F.nullif(F.col("chars"), F.lit(0))
    vivid = 10 - F.when(F.col("senses") >= 4, 0).when(F.col("senses") >= 3, 2).otherwise(5) - F.when(density("similes") >= 4, 5).when(density("similes") > 3, 3).otherwise(0)
    texture = F.when(F.col("chars") < 200, 7).otherwise(vivid)
    marks = F.col("blocking") + F.when(F.col("dashes") >= 8, 1).otherwise(0) + F.when((F.col("chars") > 200) & (density("line_similes") >= 4), 1).otherwise(0)
    consistency = F.lit(7)
    if issues is not None:
        rows = rows.join(issues.groupBy("doc_id").agg(F.sum("issues").alias("issues")), "doc_id", "left")
        consistency = _by_issues(F.coalesce("issues", F.lit(0)))
    parts = {"plot": _plot(F.col("dens")), "rhythm": rhythm, "texture": texture, "consistency": consistency, "baseline": _by_issues(marks)}
    out = rows.select("doc_id", *[F.greatest(c, F.lit(0)).cast("long").alias(k) for k, c in parts.items()])
    total = sum((F.col(k) for k in parts), F.lit(0)).cast("long")
    return out.withColumn("total", total).withColumn("flow", route(F.col("total")))


def contradictions(docs: DataFrame, ages: DataFrame, dead: DataFrame, oldest: float = 200) -> DataFrame:
    """doc_id, issues: dead people named as living (once each), and ages above ``oldest``; of what ``mentions`` and ``living_dead`` find."""
    old = ages.where((F.col("kind") == "age") & (F.col("value") > oldest)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("issues"))
    seen = dead.groupBy("doc_id").agg(F.countDistinct("name").alias("issues"))
    return old.unionByName(seen).groupBy("doc_id").agg(F.sum("issues").alias("issues"))


def canonical_checks(docs: DataFrame, genre: str, aliases: dict[str, str], checks: dict[str, tuple], default: str) -> DataFrame:
    """doc_id, genre, checks: a document's genre by its alias, or ``default``, and the checks that it enables."""
    known = F.create_map(*[F.lit(x) for a, c in {**{k: k for k in checks}, **aliases}.items() for x in (a, c)])
    enabled = F.create_map(*[F.lit(x) for g, names in checks.items() for x in (g, ",".join(names))])
    rows = docs.select("doc_id", F.coalesce(F.try_element_at(known, F.col(genre)), F.lit(default)).alias("genre"))
    return rows.select("doc_id", "genre", F.try_element_at(enabled, F.col("genre")).alias("checks"))
