"""Rules of a project: what of them is checked, by what measure, and the state of each rule for each document.

A registry lists rules with whether they are enabled.  A rule has a checker, or
needs an external tool or a person, or has nothing.  All checkers read what one
pass prepares of a text, so a plan has one scan and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import scores as X
from . import structure as S
from .scan import DASH, LIFT, PAIR, Scan

#: Rules that external tools check, rules that people check, and all rules.
EXTERNAL = ("R007", "R008", "R011", "R012", "R014", "R021", "R022")
MANUAL = ("R004", "R015", "R016", "R017", "R023", "R024")
ALL = tuple(f"R{i:03}" for i in range(1, 26))

#: Limits in millionths.
LIMITS = {"R001": 0, "R002": 4_000_000, "R003": 3_000_000, "R005": 0, "R006": 0, "R009": 350_000, "R010": 2_000_000, "R013": 0, "R018": 250_000, "R019": 5_000_000, "R020": 2_000}


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _result(actual: Column, passed: Column, failure: str | Column) -> Column:
    passed = F.coalesce(passed, F.lit(True))
    return F.struct(T.scaled(actual).alias("actual"), passed.alias("passed"), F.when(passed, "info").otherwise(failure).alias("severity"))


def checkers(scan: Scan) -> dict[str, Callable[[], Column]]:
    """Rule: (actual in millionths, passed, severity) over the columns that ``prepared`` gives; too short texts have no actual and pass."""
    pack, told = scan.pack, F.col("_narrative")
    seen = lambda x: T.visible_length(x, pack.visible)
    counted = lambda name: scan.told.count("_told_n", name).cast("double")

    def at_most(n: Column, most: float, failure: str) -> Column:
        return T.let(n.cast("double"), lambda n: _result(n, n <= most, failure))

    def negations() -> Column:
        pairs = F.transform("_kept", lambda x: T.let(T.count_matches(x, PAIR), lambda a: F.when(a > 0, a).otherwise(F.least(T.count_matches(x, LIFT), F.lit(1).cast("long")))))
        return at_most(_total(pairs), 0, "blocking")

    def dashes() -> Column:
        return T.let(T.count_matches("_lines", DASH).cast("double"), lambda n: _result(n, n <= 4, F.when(n >= 8, "blocking").otherwise("advisory")))

    def similes() -> Column:
        count = sum((T.count_matches(told, s) for s in pack.similes), F.lit(0).cast("long"))
        density = F.coalesce(count * 1000.0 / F.nullif(seen(told), F.lit(0)), F.lit(0.0))
        return T.let(density, lambda d: _result(d, d <= 3, F.when(d > 4, "blocking").otherwise("advisory")))

    def variation() -> Column:
        lengths = F.filter(F.flatten(F.transform("_told", lambda x: F.transform(T.sentences(x, pack.ends), seen))), lambda n: n > 0)
        return T.let(lengths, lambda v: T.let(F.when(F.size(v) >= 8, S.spread(v)[2]), lambda cv: _result(cv, cv >= 0.35, "blocking")))

    def templates() -> Column:
        def of(s: Column) -> Column:
            same = F.filter(F.transform(s, lambda a, i: (i < F.size(s) - 2) & (a == F.get(s, i + 1)) & (a == F.get(s, i + 2))), lambda x: x)
            return T.let(F.struct(F.size(same).alias("starts"), T.count_terms("_lines", pack.lists["vague_time"]).alias("times")), lambda n: _result((n["starts"] + n["times"]).cast("double"), (n["starts"] == 0) & (n["times"] < 2), "advisory"))

        return T.let(F.transform("_kept", lambda x: F.substring(x, 1, 2)), of)

    def variety() -> Column:
        return T.let(F.when(F.length("_full") >= 200, F.col("_full_ttr")), lambda t: _result(t, t >= 0.25, "advisory"))

    def transitions() -> Column:
        return T.let(F.when(F.length(told) >= 200, counted("transition_pattern")).otherwise(0.0), lambda n: _result(n, n < 5, "advisory"))

    def information() -> Column:
        plus = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

        def variance(d: Column) -> Column:
            n = F.nullif(F.size(d), F.lit(0))
            return F.coalesce(T.let(plus(d) / n, lambda m: plus(F.transform(d, lambda x: (x - m) * (x - m))) / n), F.lit(0.0))

        value = T.let(F.col("_full_dens"), variance)
        return T.let(F.when(F.length("_full") >= 1000, value), lambda v: _result(v, v >= 0.002, "advisory"))

    return {
        "R001": negations,
        "R002": dashes,
        "R003": similes,
        "R005": lambda: at_most(counted("banned_terms"), 0, "blocking"),
        "R006": lambda: at_most(T.count_terms(told, pack.lists["connectors"]), 0, "advisory"),
        "R009": variation,
        "R010": lambda: at_most(counted("emotion_direct"), 2, "advisory"),
        "R013": templates,
        "R018": variety,
        "R019": transitions,
        "R020": information,
    }


def prepared(docs: DataFrame, scan: Scan) -> DataFrame:
    """What ``scan`` prepares of a text, and _lines (its prose), _full (lines that count, end to end), _kept (their narratives that show a character)."""
    rows = scan.prepared(docs)
    counts = F.filter("_prose", lambda x: (x["line"] != "") & ~T.is_divider(x["line"]) & ~T.is_structural(x["line"]))
    full = F.when(F.monotonically_increasing_id() >= 0, F.array_join(F.transform(counts, lambda x: x["line"]), ""))  # stays a column, as an argument of a function
    rows = rows.select(
        "doc_id", "_narrative", "_told", "_told_n", F.array_join(F.transform("_prose", lambda x: x["line"]), "\n").alias("_lines"),
        full.alias("_full"), F.filter("_told", lambda x: T.visible_length(x, scan.pack.visible) > 0).alias("_kept"),
    )
    return rows.select("*", S.poorest_window("_full").alias("_full_ttr"), X.densities(F.col("_full"), scan.pack, scan.words).alias("_full_dens"))


def rule_states(docs: DataFrame, scan: Scan, registry: Iterable[tuple[str, bool]]) -> DataFrame:
    """doc_id, rule, status, reason, actual, threshold (both in millionths), severity of every document and rule of ``registry``.

    status is disabled, skipped (reason tells why), passed or failed.  A null or
    empty text passes what is checked.  A rule that the registry repeats is
    reported once, as it stands last.
    """
    have = checkers(scan)
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")

    def row(rule: str, status: Column, reason: Column, actual: Column = none, threshold: Column = none, severity: Column = F.lit("info")) -> Column:  # noqa: B008
        return F.struct(F.lit(rule).alias("rule"), status.alias("status"), reason.alias("reason"), actual.alias("actual"), threshold.alias("threshold"), severity.alias("severity"))

    def state(rule: str, enabled: bool) -> Column:
        if not enabled:
            return row(rule, F.lit("disabled"), text)
        if rule in have and rule not in EXTERNAL and rule not in MANUAL:
            return T.let(have[rule](), lambda x: row(rule, F.when(x["passed"], "passed").otherwise("failed"), text, x["actual"], F.lit(LIMITS[rule]).cast("long"), x["severity"]))
        return row(rule, F.lit("skipped"), F.lit("requires_external_script" if rule in EXTERNAL else "manual_check_required" if rule in MANUAL else "no_checker_defined"))

    every = F.array(*[state(r, on) for r, on in dict(registry).items()])
    return prepared(docs, scan).select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")


def execution_rates(states: DataFrame) -> DataFrame:
    """doc_id, rules, passed, failed, skipped, disabled, rate (tenths of a percent that passed, of those checked; 0 without any), blocking, advisory (whether a failure is)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    has = lambda s: F.coalesce(F.bool_or((F.col("status") == "failed") & (F.col("severity") == s)), F.lit(False)).alias(s)
    rows = states.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rules"), *map(count, ("passed", "failed", "skipped", "disabled")), *map(has, ("blocking", "advisory")))
    checked = F.col("passed") + F.col("failed")
    return rows.withColumn("rate", F.coalesce(T.scaled(F.col("passed") / F.nullif(checked, F.lit(0)), 1000), F.lit(0).cast("long")))
