"""Votes, scores, indexes, catalogs and references reconciled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RANK = {"info": 1, "advisory": 2, "blocking": 3}


def rank_of(severity: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RANK.items() for x in p]), F.col(severity)), F.lit(0))


def arbitrate(votes: DataFrame, by: str = "category") -> DataFrame:
    """key, severity, ruling: distinct agents of ``votes(key, category, agent, severity)`` decide.

    One blocking vote blocks, two advisory or three informing ones carry; else
    the highest present stands as a minority.
    """
    agents = lambda s: F.countDistinct(F.when(F.col("severity") == s, F.col("agent")))
    n = votes.groupBy("key", by).agg(*[agents(s).alias(s) for s in RANK])
    top = F.when(F.col("blocking") >= 1, "blocking").when(F.col("advisory") >= 1, "advisory").otherwise("info")
    ruling = F.when(F.col("blocking") >= 1, "blocked").when((F.col("advisory") >= 2) | ((F.col("advisory") == 0) & (F.col("info") >= 3)), "carried").when(F.col("info") >= 3, "carried").otherwise("minority")
    severity = F.when((F.col("blocking") == 0) & (F.col("advisory") == 1) & (F.col("info") >= 3), "info").otherwise(top)
    return n.select("key", by, severity.alias("severity"), ruling.alias("ruling"))


def composite(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """key, score (millionths): mean of ``scores(key, source, score)`` weighted over the sources present; repeated sources count once, the highest."""
    w = F.create_map(*[F.lit(x) for p in weights.items() for x in p])
    one = scores.groupBy("key", "source").agg(F.max("score").alias("score")).withColumn("_w", F.try_element_at(w, F.col("source"))).where("_w is not null")
    return one.groupBy("key").agg(T.scaled(F.sum(F.col("score") * F.col("_w")) / F.sum("_w")).alias("score"))


def keyword_index(docs: DataFrame, terms: dict[str, tuple]) -> DataFrame:
    """keyword, kind, doc_id, n: postings of known entities."""
    counts = [F.struct(F.lit(w).alias("keyword"), F.lit(kind).alias("kind"), T.count_literal("text", w).alias("n")) for kind, words in terms.items() for w in words]
    return docs.select("doc_id", F.explode(F.filter(F.array(*counts), lambda x: x["n"] > 0)).alias("x")).select("x.keyword", "x.kind", "doc_id", "x.n")


def query_index(postings: DataFrame, query: str) -> DataFrame:
    """Postings whose keyword is the query; where there is none, whose keyword holds it or is held by it."""
    q = F.lit(query)
    exact = postings.where(F.col("keyword") == q)
    near = postings.where(F.contains("keyword", q) | F.contains(q, F.col("keyword")))
    found = exact.limit(1).select(F.lit(True).alias("_some"))
    return near.join(F.broadcast(found), F.lit(True), "left").where((F.col("keyword") == q) | F.col("_some").isNull()).drop("_some")  # at most one row is broadcast


def merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old postings of documents that were not read again, and the new ones."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(old.columns).unionByName(new)


def upsert(state: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """State with the delta's non-null fields written over it, and its new keys."""
    names = [c for c in state.columns if c != key]
    s, d = state.alias("s"), delta.alias("d")
    return s.join(d, key, "full_outer").select(key, *[F.coalesce(F.col(f"d.{c}"), F.col(f"s.{c}")).alias(c) for c in names])


def dead_links(links: DataFrame, existing: DataFrame, archive: DataFrame) -> DataFrame:
    """doc, target, status of each link of ``links(doc, target)``: ok, archived or dead."""
    have = existing.select("target").distinct().withColumn("_e", F.lit(True))
    kept = archive.select("target").distinct().withColumn("_a", F.lit(True))
    rows = links.join(have, "target", "left").join(kept, "target", "left")
    return rows.select("doc", "target", F.when(F.col("_e"), "ok").when(F.col("_a"), "archived").otherwise("dead").alias("status"))


def versions(files: DataFrame, table: DataFrame) -> DataFrame:
    """name, status: files of ``files(name, version)`` against ``table(name, version)``: ok, mismatch or missing."""
    t = table.select("name", F.col("version").alias("_v"), F.lit(True).alias("_in"))
    status = F.when(F.col("_in").isNull(), "missing").when(F.col("version").eqNullSafe(F.col("_v")), "ok").otherwise("mismatch")
    return files.join(t, "name", "left").select("name", status.alias("status"))


def regression(baseline: DataFrame, current: DataFrame, slack: int = 5) -> DataFrame:
    """id, status: a total more than ``slack`` under the baseline, or more blocking findings, is a regression; null totals are pending."""
    b = baseline.select("id", F.col("total").alias("_t"), F.col("blocking").alias("_b"))
    rows = b.join(current, "id", "left")
    worse = (F.col("total") < F.col("_t") - slack) | (F.col("blocking") > F.col("_b"))
    status = F.when(F.col("_t").isNull() | F.col("total").isNull(), "pending").when(worse, "regression").when(F.col("total") > F.col("_t"), "improvement").otherwise("pass")
    return rows.select("id", status.alias("status"))


def telemetry(rules: DataFrame, results: DataFrame) -> DataFrame:
    """rule, status: passed, failed, skipped (no result) or disabled, of ``rules(rule, enabled)`` and ``results(rule, passed)``."""
    rows = rules.join(results, "rule", "left")
    return rows.select("rule", F.when(~F.col("enabled"), "disabled").when(F.col("passed").isNull(), "skipped").when(F.col("passed"), "passed").otherwise("failed").alias("status"))


def context_cost(files: DataFrame, tokens: int = 15, limit: int = 2000) -> DataFrame:
    """section, lines, tokens, heavy of ``files(section, file, lines)``; a file counts once a section, a missing one (-1) not."""
    one = files.where("lines >= 0").groupBy("section", "file").agg(F.max("lines").alias("lines"))
    return one.groupBy("section").agg(F.sum("lines").alias("lines")).select("section", "lines", (F.col("lines") * tokens).alias("tokens"), (F.col("lines") > limit).alias("heavy"))


def overdue(items: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Active items of ``items(id, status, start)`` planted more than ``limit`` chapters ago."""
    return items.where((F.col("status") == "ACTIVE") & (now - F.col("start") > limit)).select("id", (now - F.col("start")).cast("long").alias("age"))


def severity_pivot(found: DataFrame) -> DataFrame:
    """type, blocking, advisory, info: counts of findings."""
    return found.groupBy("type").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("blocking", "advisory", "info")])


def gate(found: DataFrame) -> DataFrame:
    """doc_id, code: 1 where a document has a finding, 2 where it has a blocking one."""
    return found.groupBy("doc_id").agg(F.max(rank_of("severity")).alias("_r")).select("doc_id", F.when(F.col("_r") == 3, 2).otherwise(1).cast("long").alias("code"))


def exit_codes(files: DataFrame, found: DataFrame, rejects: DataFrame | None = None, fail_on: str = "any") -> DataFrame:
    """doc_id, code of each of ``files(doc_id)`` and ``rejects(doc_id)``: 2 where a file could not be read, 1 where it has findings (with ``fail_on='blocking'`` blocking ones), else 0."""
    counts = found if fail_on == "any" else found.where(F.col("severity") == fail_on)
    each = counts.select("doc_id", F.lit(1).cast("long").alias("code")).unionByName(files.select("doc_id", F.lit(0).cast("long").alias("code")))
    if rejects is not None:
        each = each.unionByName(rejects.select("doc_id", F.lit(2).cast("long").alias("code")))
    return each.groupBy("doc_id").agg(F.max("code").alias("code"))


def compacted(history: DataFrame) -> DataFrame:
    """key, value, kinds: the last value of each key of ``history(key, seq, value)`` and all its values in order of first use."""
    first = history.groupBy("key", "value").agg(F.min("seq").alias("seq"))
    kinds = first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), ",").alias("kinds"))
    return history.groupBy("key").agg(F.max_by("value", "seq").alias("value")).join(kinds, "key")
