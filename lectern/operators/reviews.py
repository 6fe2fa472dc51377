"""Findings with their places, reviewers' votes, rules and project state, as grouped and joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import Pack
from . import structure as S
from .matching import Lexicon

#: Which lists are looked for on each narrative line, under which type and severity; data, so that one pass serves all.
LOCATED = (("connectors", "ai-connector", "advisory"), ("emotion_direct", "emotion-direct", "advisory"), ("ban_a", "narrative-ban-a", "blocking"), ("ban_b", "narrative-ban-b", "advisory"), ("cliches", "cliched-appearance", "advisory"))


def alternation(terms) -> str:
    return "|".join(sorted({*terms}, key=lambda w: (-len(w), w)))


def quoted_terms(terms) -> str:
    """The same for terms that may hold signs of the expression language."""
    import re

    return "|".join(re.escape(w) for w in sorted({*terms}, key=lambda w: (-len(w), w)))


def located(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, line_no, col (from 1), type, severity, excerpt: every term of the LOCATED lists on lines without their quotes; the longest term at a place, for each list.

    A line is read once for all lists, and a finding's excerpt is cut there.
    """
    found = Lexicon({kind: pack.lists[name] for name, kind, _ in LOCATED}).apart("narrative", 6, 18)
    severity = F.create_map(*[F.lit(x) for _, kind, grade in LOCATED for x in (kind, grade)])
    rows = S.narrative_lines(docs, pack).select("doc_id", "line_no", found.alias("_h"))
    each = rows.select("doc_id", "line_no", F.explode("_h").alias("x"))
    return each.select("doc_id", "line_no", F.col("x.pos").cast("long").alias("col"), F.col("x.list").alias("type"), F.try_element_at(severity, F.col("x.list")).alias("severity"), T.compact("x.near").alias("excerpt"))


def reports(found: DataFrame) -> DataFrame:
    """doc_id, n, report, code: a document's findings by (line, column, type) as JSON, and its gate: 2 with a blocking one, else 1."""
    order = F.array_sort(F.collect_list(F.struct("line_no", "col", "type", "severity")))
    code = F.when(F.max((F.col("severity") == "blocking").cast("int")) == 1, 2).otherwise(1).cast("long")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.to_json(order).alias("report"), code.alias("code"))


def merged(found: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """key, severity, category, sources, n, place: findings of one (key, category, line) as one, with the highest severity, in order of severity and category.

    ``found(key, category, line, severity, source)``.
    """
    rank = F.create_map(*[F.lit(x) for p in ranks.items() for x in p])
    rows = found.withColumn("_r", F.coalesce(F.try_element_at(rank, F.col("severity")), F.lit(0)))
    one = rows.groupBy("key", "category", "line").agg(F.max_by("severity", "_r").alias("severity"), F.max("_r").alias("_r"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_r"), "category", "line"))
    return one.select("key", "severity", "category", "line", "sources", "n", place.cast("long").alias("place"))


def majority(found: DataFrame, valid: tuple[str, ...]) -> DataFrame:
    """key, source: the commonest valid source of ``found(key, ord, source)``, where a source may name several with ``+``; ties go to the one seen first."""
    parts = found.select("key", "ord", F.posexplode(F.split("source", r"\+")).alias("_i", "_s")).select("key", "ord", "_i", F.trim("_s").alias("source")).where(F.col("source").isin(*valid))
    counts = parts.groupBy("key", "source").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "_i")).alias("_first"))
    return counts.groupBy("key").agg(F.min_by("source", F.struct(-F.col("n"), F.col("_first"))).alias("source"))


def dimension_means(scores: DataFrame) -> DataFrame:
    """key, dim, score, reasons: mean of ``scores(key, dim, ord, score, reason)`` to one decimal (halves up), and the distinct reasons in order."""
    reasons = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda x: x["reason"])), ",")
    return scores.groupBy("key", "dim").agg((F.floor(F.sum("score") * 10 / F.count("score") + 0.5) / 10).alias("score"), reasons.alias("reasons"))


def quiet_windows(docs: DataFrame, spans: str, info: str, least: int = 6, size: int = 3) -> DataFrame:
    """doc_id, windows, quiet: texts of ``least`` dialogue spans and more, by windows of ``size``; a quiet one has no word that brings news."""
    lines = F.filter(S.prose("text"), lambda x: (x["line"] != "") & ~T.is_divider(x["line"]) & ~T.is_structural(x["line"]))
    said = F.filter(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x["line"], F.lit(spans), F.lit(1)))), lambda s: s != "")
    rows = docs.select("doc_id", said.alias("_s")).where(F.size("_s") >= least)
    windows = F.transform(F.sequence(F.lit(0), F.floor(F.size("_s") / size) - 1), lambda i: F.slice("_s", (i * size + 1).cast("int"), F.lit(size)))
    quiet = F.size(F.filter(windows, lambda w: ~F.exists(w, lambda s: s.rlike(info))))
    return rows.select("doc_id", F.floor(F.size("_s") / size).cast("long").alias("windows"), quiet.cast("long").alias("quiet")).where("quiet > 0")


#: Registry of rules: the largest measure that passes, and the severity of a failure.
RULES = {"dashes": (4, "blocking"), "connectors": (0, "advisory"), "banned": (0, "blocking"), "emotion": (20, "advisory"), "transitions": (40, "advisory"), "breathy": (3, "advisory")}


def measures(pack: Pack) -> dict[str, Column]:
    """What each rule of the registry measures of a text."""
    return {
        "dashes": T.count_matches("text", "——|—|--+"),
        "connectors": T.count_matches("text", f"(?:{alternation(pack.lists['connectors'])})[,，。！？!?.]"),
        "banned": T.count_terms("text", pack.lists["ban_a"]),
        "emotion": T.count_terms("text", pack.lists["emotion_direct"]),
        "transitions": T.count_terms("text", pack.lists["transitions"]),
        "breathy": T.count_terms("text", pack.lists["breathy"]),
    }


def checked(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, rule, passed, actual, threshold, severity of every document and rule, in one pass."""
    each = [F.struct(F.lit(k).alias("rule"), n.cast("long").alias("actual"), F.lit(RULES[k][0]).cast("long").alias("threshold"), F.lit(RULES[k][1]).alias("severity")) for k, n in measures(pack).items()]
    rows = docs.select("doc_id", F.explode(F.array(*each)).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "rule", (F.col("actual") <= F.col("threshold")).alias("passed"), "actual", "threshold", "severity")


def pass_rates(results: DataFrame, known: dict[str, str]) -> DataFrame:
    """rule, status, passed, failed, rate (millionths): of ``results(rule, passed)`` and of known rules without a checker, which are skipped as ``known`` says."""
    counts = results.groupBy("rule").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    names = results.sparkSession.createDataFrame([(k, v) for k, v in known.items()], "rule string, _why string")
    rows = counts.join(names, "rule", "full_outer")
    status = F.when(F.col("passed").isNull(), F.col("_why")).when(F.col("failed") > 0, "failed").otherwise("passed")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("rule", status.alias("status"), zero("passed"), zero("failed"), T.scaled(F.col("passed") / F.nullif(F.col("passed") + F.col("failed"), F.lit(0))).alias("rate"))


def known_ids(delta: DataFrame, known: DataFrame) -> DataFrame:
    """book, id, status of ``delta(book, id, action)``: unknown where a book with known ids lacks it, and it is not being planted."""
    have = known.select("book", "id").distinct().withColumn("_in", F.lit(True))
    books = known.select("book").distinct().withColumn("_some", F.lit(True))
    rows = delta.join(have, ["book", "id"], "left").join(books, "book", "left")
    unknown = F.col("_some").isNotNull() & F.col("_in").isNull() & (F.col("action") != "plant")
    return rows.select("book", "id", F.when(unknown, "unknown").otherwise("ok").alias("status"))


def set_unions(known: DataFrame, delta: DataFrame) -> DataFrame:
    """key, members: each key's members of both ``(key, member)`` tables, in order, as one string."""
    both = known.select("key", "member").unionByName(delta.select("key", "member"))
    return both.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("member")), ",").alias("members"))


def project_gaps(prose: DataFrame, outlines: DataFrame) -> DataFrame:
    """chapter, gap: chapters of ``prose(chapter)`` without an outline, and outlined ones without prose; whole numbers, so 1 is not 10."""
    p, o = prose.select("chapter").distinct().withColumn("_p", F.lit(True)), outlines.select("chapter").distinct().withColumn("_o", F.lit(True))
    return p.join(o, "chapter", "full_outer").where("_p is null or _o is null").select("chapter", F.when(F.col("_o").isNull(), "no outline").otherwise("no prose").alias("gap"))


def write_gate(docs: DataFrame, found: DataFrame, pack: Pack, least: int = 3500) -> DataFrame:
    """doc_id, blocking, advisory, short: tallies of a document's findings, and whether it has fewer than ``least`` visible characters."""
    tally = found.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("blocking", "advisory")])
    sizes = docs.select("doc_id", (T.visible_length("text", pack.visible) < least).alias("short"))
    return sizes.join(tally, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocking", "advisory")], "short")


def state_proximity(docs: DataFrame, names: tuple[str, ...], states: tuple[str, ...], around: int = 30) -> DataFrame:
    """doc_id, name, pos, state: for each place of a name, the first word of state within ``around`` characters."""
    p, near = quoted_terms(names), quoted_terms(states)
    hits = T.spans(F.split("text", p, -1), F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    rows = docs.where(F.col("text").rlike(p)).select("doc_id", "text", F.explode(hits).alias("x"))
    start = F.greatest(F.col("x.pos") - around, F.lit(1))
    context = F.substring("text", start, F.col("x.pos") + F.length("x.found") + around - start)
    found = F.regexp_extract(context, f"({near})", 1)
    return rows.select("doc_id", F.col("x.found").alias("name"), F.col("x.pos").cast("long").alias("pos"), found.alias("state")).where("state <> ''")


def dashboard(chapters: DataFrame, goal: int, last: int = 10) -> DataFrame:
    """book, chapters, progress (percent of ``goal``, 100 at most), recent (mean score of the last ``last`` scored chapters, in thousandths), and counts by status.

    ``chapters(book, chapter_no, score, status)``, where score may be null.
    """
    recent = F.row_number().over(Window.partitionBy("book", F.col("score").isNull()).orderBy(F.desc("chapter_no")))
    rows = chapters.withColumn("_r", recent)
    statuses = {s: F.count_if(F.col("status") == s).alias(s) for s in ("green", "yellow", "red")}
    return rows.groupBy("book").agg(
        F.count(F.lit(1)).alias("chapters"),
        F.least(F.floor(F.count(F.lit(1)) * 100 / goal), F.lit(100)).cast("long").alias("progress"),
        T.scaled(F.avg(F.when(F.col("score").isNotNull() & (F.col("_r") <= last), F.col("score"))), 1e3).alias("recent"),
        *statuses.values(),
    )


def schema_violations(rows: DataFrame, key: str, json: str, schema: dict) -> DataFrame:
    """key, path, error: where a JSON column breaks a schema of the kinds type, required, properties, enum, minimum, maximum and minLength.

    A wrong type ends the checks of that path.  The schema becomes expressions, so
    any number of rows is checked in one pass.
    """
    whole = F.try_parse_json(json)
    bad: list[Column] = []

    def note(path: str, error: str, when: Column) -> None:
        bad.append(F.when(when, F.struct(F.lit(path).alias("path"), F.lit(error).alias("error"))))

    kinds = {"object": r"^OBJECT", "string": r"^STRING", "integer": r"^BIGINT", "number": r"^(BIGINT|DOUBLE|DECIMAL)", "boolean": r"^BOOLEAN", "array": r"^ARRAY"}

    def walk(node: dict, path: str, parent: Column) -> None:
        at = F.try_variant_get(whole, path, "variant")
        there = at.isNotNull()
        fits = F.schema_of_variant(at).rlike(kinds[node["type"]]) if "type" in node else F.lit(True)
        if "type" in node:
            note(path, "type", there & ~fits)
        text, number = F.try_variant_get(whole, path, "string"), F.try_variant_get(whole, path, "double")
        if "enum" in node:
            note(path, "enum", there & fits & ~text.isin(*map(str, node["enum"])))
        if "minimum" in node:
            note(path, "minimum", there & fits & (number < node["minimum"]))
        if "maximum" in node:
            note(path, "maximum", there & fits & (number > node["maximum"]))
        if "minLength" in node:
            note(path, "minLength", there & fits & (F.length(text) < node["minLength"]))
        for name in node.get("required", ()):
            note(f"{path}.{name}", "required", there & fits & F.try_variant_get(whole, f"{path}.{name}", "variant").isNull())
        for name, child in node.get("properties", {}).items():
            walk(child, f"{path}.{name}", fits)

    note("$", "json", whole.isNull())
    walk(schema, "$", F.lit(True))
    return rows.select(key, F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("x")).select(key, "x.path", "x.error")
