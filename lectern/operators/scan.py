"""All findings that one text decides, in one pass over the texts.

A detector is a column: an array of one (severity, n) or none, over what is
prepared of a row: its lines of prose, their narrative, its sentences, and the
counts of all lists by one automaton.  No detector leaves its row, so a plan of
any of them has one scan and no shuffle, and the optimizer drops what the chosen
ones don't use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import Pack
from . import scores as X
from . import structure as S
from .matching import Lexicon, chosen

FOUND = "array<struct<severity:string,n:bigint>>"
DASH = "——|—|--+"
NO = "(?:没有|不是|并非)"
PAIR = NO + "[^，。；！？\n]{2,30}[，]" + NO + "[^，。；！？\n]{2,30}[，]"
LIFT = NO + "[^，。；！？\n]{2,60}[，].*?(?:而是|只有|那是一种|那是|只剩|唯有)"

#: Lists counted: type, severities from which count, and where (a whole text or its narrative).
COUNTED = {
    "emotion_direct": ("emotion-direct", "emotion_direct", 1, None, "told"),
    "banned_terms": ("narrative-ban-a", "ban_a", None, 1, "told"),
    "banned_terms_b": ("narrative-ban-b", "ban_b", 3, None, "told"),
    "transition_pattern": ("transition-pattern", "transitions", 5, None, "told"),
    "vague_time": ("vague-time-jump", "vague_time", 2, None, "whole"),
    "cliche_terms": ("cliched-appearance", "cliches", 1, None, "whole"),
    "breathy_tags": ("breathy-dialogue-tags", "breathy", 4, None, "whole"),
}


def one(severity: Column, n: Column) -> Column:
    """A finding, or none where the severity is null."""
    return F.when(severity.isNotNull(), F.array(F.struct(severity.alias("severity"), n.cast("long").alias("n")))).otherwise(F.array().cast(FOUND))


def graded(n: Column, advisory: float | None, blocking: float | None) -> Column:
    def of(n: Column) -> Column:
        out = F.lit(None).cast("string")
        if advisory is not None:
            out = F.when(n >= advisory, F.lit("advisory")).otherwise(out)
        if blocking is not None:
            out = F.when(n >= blocking, F.lit("blocking")).otherwise(out)
        return one(out, n)

    return T.let(F.coalesce(n, F.lit(0)).cast("long"), of)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


@dataclass(frozen=True)
class Scan:
    """Detectors with the lists of a pack; ``words`` is the dictionary for the density of information."""

    pack: Pack
    words: tuple = ()

    @cached_property
    def told(self) -> Lexicon:
        return Lexicon({k: self.pack.lists[name] for k, (_, name, _, _, where) in COUNTED.items() if where == "told"})

    @cached_property
    def whole(self) -> Lexicon:
        lists = {k: self.pack.lists[name] for k, (_, name, _, _, where) in COUNTED.items() if where == "whole"}
        return Lexicon(lists | {"slang": [w for ws in self.pack.grades.values() for w in ws]})

    @cached_property
    def feelings(self) -> tuple[Lexicon, dict[str, str]]:
        category = {w: k for k, ws in self.pack.categories.items() for w in ws if w not in self.pack.excludes}
        return Lexicon({"": [*(w for ws in self.pack.categories.values() for w in ws), *self.pack.excludes]}), category

    def prepared(self, docs: DataFrame) -> DataFrame:
        """doc_id, text and what the detectors read of it."""
        rows = docs.select("doc_id", "text", S.prose(F.coalesce("text", F.lit(""))).alias("_prose"))
        counts = F.filter("_prose", lambda x: (x["line"] != "") & ~T.is_divider(x["line"]) & ~T.is_structural(x["line"]))
        rows = rows.select("*", F.transform(counts, lambda x: T.strip_quoted(x["line"])).alias("_told"))
        # a row's number keeps the optimizer from moving the expression into the function's arguments, where it can't be run
        rows = rows.select("*", F.when(F.monotonically_increasing_id() >= 0, F.array_join("_told", "")).alias("_narrative"))
        lexicon, category = self.feelings
        return rows.select("*", self.told.counts("_narrative").alias("_told_n"), self.whole.counts("text").alias("_whole_n"), chosen(lexicon.longest("text"), category).alias("_feelings"), S.poorest_window("text").alias("_ttr"), X.densities(F.col("text"), self.pack, self.words).alias("_dens"))

    @cached_property
    def detectors(self) -> dict[str, list[tuple[str, Callable[[], Column]]]]:
        """Name of a detector: (type, column of findings) of each type that it finds."""
        p = self.pack
        told, text = F.col("_narrative"), F.col("text")
        lists = {
            k: [(kind, lambda k=k, a=a, b=b, where=where: graded(self.told.count("_told_n", k) if where == "told" else self.whole.count("_whole_n", k), a, b))]
            for k, (kind, _, a, b, where) in COUNTED.items()
        }
        return lists | {
            "dash_count": [("em-dash", lambda: graded(T.count_matches(F.array_join(F.transform("_prose", lambda x: x["line"]), "\n"), DASH), 5, 8))],
            "connector_hits": [("ai-connector", lambda: graded(T.count_matches(told, "(" + "|".join(p.lists["connectors"]) + ")[,，。！？!?.]"), 1, None))],
            "simile_density": [("metaphor-density", self._similes)],
            "burstiness": [("burstiness", self._burstiness)],
            "ttr_low": [("ttr-low", self._variety)],
            "transition_stacking": [("transition-stacking", self._starts)],
            "prefix_triples": [("parallelism-abuse", self._triples)],
            "emotion_variety": [("emotion-density", lambda: self._feelings(True)), ("emotion-variety", lambda: self._feelings(False))],
            "slang_density": [("slang-density", lambda: graded(self.whole.count("_whole_n", "slang"), 4, None))],
            "info_density": [("info-density-uniform", self._information)],
            "negation_parallel": [("negation-parallelism", self._negations)],
            "contrast_counts": [("parallelism-abuse", lambda: graded(T.count_matches(text, p.blocking[0]), 2, None))],
        }

    def findings(self, docs: DataFrame, *names: str) -> DataFrame:
        """doc_id, type, severity, n of the named detectors, or of all."""
        own = [(kind, of) for k in names or self.detectors for kind, of in self.detectors[k]]

        def named(kind: str):
            return lambda x: F.struct(F.lit(kind).alias("type"), x["severity"].alias("severity"), x["n"].alias("n"))

        every = F.flatten(F.array(*[F.transform(of(), named(kind)) for kind, of in own]))
        return self.prepared(docs).select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.type", "x.severity", "x.n")

    def repeats(self, docs: DataFrame) -> DataFrame:
        """doc_id, kind (image or reaction), term, line_no (of the first), severity, n: terms on three and more lines of narrative, blocking from five on; a row is not left."""
        lists = {"image": self.pack.lists["imagery"], "reaction": self.pack.reactions}
        kind = F.create_map(*[F.lit(x) for k, ws in reversed(lists.items()) for w in ws for x in (w, k)])
        counts = F.filter("_prose", lambda x: (x["line"] != "") & ~T.is_divider(x["line"]) & ~T.is_structural(x["line"]))
        told = F.filter(F.transform(counts, lambda x: F.struct(x["line_no"].alias("line_no"), T.strip_quoted(x["line"]).alias("told"))), lambda x: T.visible_length(x["told"], self.pack.visible) > 0)
        rows = docs.select("doc_id", S.prose(F.coalesce("text", F.lit(""))).alias("_prose"))
        rows = rows.select("doc_id", F.when(F.monotonically_increasing_id() >= 0, told).alias("_l"))
        rows = rows.select("doc_id", F.transform("_l", lambda x: x["line_no"]).alias("_no"), F.when(F.monotonically_increasing_id() >= 0, F.transform("_l", lambda x: x["told"])).alias("_told"))
        rows = rows.select("doc_id", "_no", Lexicon(lists).lines("_told").alias("_r"))
        each = rows.select("doc_id", "_no", F.explode(F.filter("_r", lambda x: x["n"] >= 3)).alias("x"))
        return each.select("doc_id", F.try_element_at(kind, F.col("x.term")).alias("kind"), "x.term", F.element_at("_no", F.col("x.first")).alias("line_no"), F.when(F.col("x.n") >= 5, "blocking").otherwise("advisory").alias("severity"), "x.n")

    def _similes(self, least: int = 200) -> Column:
        """Similes for each 1000 visible characters: above 3 advisory, above 4 blocking; n is the density in millionths."""
        count = sum((T.count_matches("_narrative", s) for s in self.pack.similes), F.lit(0).cast("long"))

        def of(x: Column) -> Column:
            density = x["c"] * 1000.0 / F.nullif(x["v"], F.lit(0))
            return T.let(density, lambda d: one(F.when((x["v"] >= least) & (d > 4), "blocking").when((x["v"] >= least) & (d > 3), "advisory"), T.scaled(d)))

        return T.let(F.struct(count.alias("c"), T.visible_length("_narrative", self.pack.visible).alias("v")), of)

    def _burstiness(self, least: int = 8) -> Column:
        """Even lengths of narrated sentences; n is their variation in millionths."""
        lengths = F.flatten(F.transform("_told", lambda x: F.transform(T.sentences(x, self.pack.ends), lambda s: T.visible_length(s, self.pack.visible))))

        def of(v: Column) -> Column:
            return T.let(S.spread(v)[2], lambda cv: one(F.when((F.size(v) >= least) & (cv < 0.35), "blocking").when((F.size(v) >= least) & (cv < 0.5), "advisory"), T.scaled(cv)))

        return T.let(F.filter(lengths, lambda n: n > 0), of)

    def _variety(self, least: int = 200) -> Column:
        """A poorest window of tokens with under a quarter distinct; n in millionths."""
        return one(F.when((F.length("text") >= least) & (F.col("_ttr") < 0.25), "advisory"), T.scaled(F.col("_ttr")))

    def _starts(self) -> Column:
        """Lines that begin with a transition, of all lines of the text."""
        def begins(line: Column) -> Column:
            out = F.lit(False)
            for t in self.pack.lists["starts"]:
                out = out | F.startswith(line, F.lit(t))
            return out

        return graded(F.size(F.filter(F.split("text", r"\r?\n", -1), lambda x: begins(T.jtrim(x)))), 3, None)

    def _triples(self) -> Column:
        """Three sentences running that share their first characters (up to four, two at least)."""
        def of(s: Column) -> Column:
            def same(a: Column, i: Column) -> Column:
                b, c = F.get(s, i + 1), F.get(s, i + 2)
                k = F.least(F.lit(4), F.length(a), F.length(b), F.length(c))
                return (k >= 2) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)) & (F.substring(a, F.lit(1), k) == F.substring(c, F.lit(1), k))

            return F.size(F.filter(F.transform(s, lambda a, i: (i < F.size(s) - 2) & same(a, i)), lambda x: x))

        return graded(T.let(T.sentences("text", self.pack.ends), of), None, 1)

    def _feelings(self, density: bool) -> Column:
        """Too few or many hits for each 1000 characters that aren't blank, or too few categories."""
        chars = F.length(F.regexp_replace("text", r"\s+", ""))
        if not density:
            return T.let(F.size(F.array_distinct("_feelings")), lambda n: one(F.when((chars > 0) & (n < 3), "advisory"), n))
        scaled = T.scaled(F.size("_feelings") * 1000.0 / F.nullif(chars, F.lit(0)))
        return T.let(scaled, lambda d: one(F.when(d < 3_000_000, "advisory").when(d > 15_000_000, "blocking"), d))

    def _information(self, size: int = 500) -> Column:
        """Density of information that hardly varies over three and more segments; n is the variance in millionths."""
        def of(d: Column) -> Column:
            mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(d), F.lit(0))
            variance = T.let(mean, lambda m: F.aggregate(F.transform(d, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(d), F.lit(0)))
            return T.let(variance, lambda v: one(F.when((F.size(d) >= 3) & (v < 0.002), "advisory"), T.scaled(v)))

        return T.let(F.when(F.length("text") >= 2 * size, F.col("_dens")).otherwise(F.array().cast("array<double>")), of)

    def _negations(self) -> Column:
        """Two clauses running that start with a negation; a lifting end counts on lines that have no such pair."""
        lines = F.filter("_told", lambda x: T.visible_length(x, self.pack.visible) > 0)
        each = F.transform(lines, lambda x: T.let(T.count_matches(x, PAIR), lambda a: F.when(a > 0, a).otherwise(F.least(T.count_matches(x, LIFT), F.lit(1).cast("long")))))
        return graded(_sum(each), None, 1)
