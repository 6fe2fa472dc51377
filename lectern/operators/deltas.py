"""Chapter deltas of a project: rulings in order of arrival, and the state that accepted ones add up to.

A delta is checked in two steps.  What it shows by itself, or against what is
known of its book (ids, tiers), are column expressions.  What depends on the
deltas before it (its chapter follows, the dead stay dead, ages don't fall) is a
fold over a book: ``Book`` holds what that needs.  A delta with any error is
degraded and changes nothing; the others are synced.

The state needs no fold: it is the last value of each key over the synced deltas.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Contract of a delta: what a chapter changes.
DELTA = (
    "struct<character_states:array<struct<id:string,alive:boolean,combat_level:string>>,"
    "number_anchors_updated:struct<character_age:map<string,double>>,"
    "foreshadowing_ops:array<struct<id:string,action:string,summary:string>>,"
    "knowledge_boundary_updates:array<struct<character_id:string,newly_known:array<string>,still_unknown:array<string>>>,"
    "timeline:map<string,string>>"
)
DELTAS = f"book string, seq long, chapter long, delta {DELTA}"
BOOKS = "book string, characters array<string>, foreshadowing array<string>, tiers array<string>, max_tier string"
ACTIONS = ("plant", "advance", "reap", "hint")
RULED = "book string, seq long, chapter long, status string, errors array<string>"


def _each(name: str, of) -> Column:
    """What ``of`` gives for the members of an array of the delta; none where there is none."""
    return F.coalesce(F.transform(f"delta.{name}", of), F.array().cast("array<string>"))


def prepared(deltas: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """book, seq, chapter, errors (found without the deltas before), facts (JSON of what the fold needs).

    ``books`` has a row for each book with the ids and tiers that it knows; a book
    without a row, or an empty list, leaves the check out.
    """
    if books is not None:
        deltas = deltas.join(books, "book", "left")
    else:
        deltas = deltas.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (x.strip().split(" ") for x in BOOKS.split(", ")[1:])])
    none = F.lit(None).cast("string")
    blank = lambda x: x.isNull() | (x == "")
    unknown = lambda x, known: (F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0) & ~F.coalesce(F.array_contains(known, x), F.lit(False))
    limit = F.coalesce(F.array_position("tiers", F.col("max_tier")), F.lit(0))
    errors = F.concat(
        F.array(F.when(F.col("chapter").isNull() | (F.col("chapter") < 1), F.lit("chapter")), F.when(F.col("delta").isNull(), F.lit("delta"))),
        _each("character_states", lambda c: F.when(blank(c["id"]), F.lit("character id"))),
        _each("foreshadowing_ops", lambda o: F.when(blank(o["id"]), F.lit("foreshadowing id"))),
        _each("foreshadowing_ops", lambda o: F.when(o["action"].isNull() | ~o["action"].isin(*ACTIONS), F.concat(F.lit("action "), F.coalesce(o["action"], F.lit("null"))))),
        _each("character_states", lambda c: F.when(~blank(c["id"]) & unknown(c["id"], F.col("characters")), F.concat(F.lit("unknown character "), c["id"]))),
        _each("foreshadowing_ops", lambda o: F.when(~blank(o["id"]) & ~o["action"].eqNullSafe(F.lit("plant")) & unknown(o["id"], F.col("foreshadowing")), F.concat(F.lit("unknown foreshadowing "), o["id"]))),
        _each("character_states", lambda c: F.when(F.col("max_tier").isNotNull() & (F.coalesce(F.array_position("tiers", c["combat_level"]), F.lit(0)) > limit), F.concat(F.lit("tier "), F.coalesce(c["id"], F.lit("null")))).otherwise(none)),
    )
    facts = F.to_json(F.struct(F.transform("delta.character_states", lambda c: F.struct(c["id"].alias("id"), c["alive"].alias("alive"))).alias("lives"), F.col("delta.number_anchors_updated.character_age").alias("ages")))
    return deltas.select("book", "seq", "chapter", F.filter(errors, lambda e: e.isNotNull()).alias("errors"), facts.alias("facts"))


class Book:
    """What rulings on a book's next delta need; ``dead`` is a set or whatever holds ids like one."""

    def __init__(self, last: int = 0, ages: dict | None = None, dead=None):
        self.last, self.ages, self.dead = last, ages or {}, set() if dead is None else dead

    def rule(self, chapter: int | None, errors: Iterable[str], facts: str) -> tuple[str, list[str]]:
        """(status, errors) of a delta; one without errors is taken over."""
        known = json.loads(facts)
        lives, ages, errors = known.get("lives") or [], known.get("ages"), list(errors)
        if chapter != self.last + 1:
            errors.append(f"continuity {self.last + 1}")
        errors += [f"resurrection {x['id']}" for x in lives if x.get("alive") is True and x.get("id") in self.dead]
        errors += [f"age {i}" for i, age in (ages or {}).items() if age is not None and i in self.ages and age < self.ages[i]]
        if errors:
            return "degraded", sorted(errors)
        self.last = chapter
        for x in lives:
            if x.get("alive") is False:
                self.dead.add(x["id"])
        if ages is not None:
            self.ages = ages  # the new table of ages replaces the old one
        return "synced", []


def rulings(deltas: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """book, seq, chapter, status, errors (in order of their names) of every row of ``deltas(book, seq, chapter, delta)``, in order of ``seq`` within a book.

    A book's deltas depend on each other, so they pass through one task, sorted by
    Spark, a batch at a time; what is held is the dead and the ages of one book.
    Null books are a book; equal ``seq`` are in order of chapter and facts.
    """

    def fold(batches):
        name, state, none = None, None, object()
        name = none
        for b in batches:
            out = []
            for book, seq, chapter, errors, facts in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if book != name:
                    name, state = book, Book()
                out.append((book, seq, chapter, *state.rule(chapter, errors, facts)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["book", "seq", "chapter", "status", "errors"])

    return prepared(deltas, books).repartition("book").sortWithinPartitions("book", "seq", "chapter", "facts").mapInArrow(fold, RULED)


def accepted(deltas: DataFrame, ruled: DataFrame) -> DataFrame:
    """The deltas that ``ruled`` syncs; ``seq`` names a delta of a book."""
    return deltas.join(ruled.where("status = 'synced'").select("book", "seq"), ["book", "seq"])


def character_state(synced: DataFrame) -> DataFrame:
    """book, id, alive, combat_level: of each, the last value that a synced delta gives."""
    rows = synced.select("book", "seq", F.posexplode("delta.character_states").alias("i", "c")).select("book", F.struct("seq", "i").alias("at"), "c.*")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return rows.groupBy("book", "id").agg(last("alive"), last("combat_level"))


def foreshadowing_state(synced: DataFrame) -> DataFrame:
    """book, id, status, planted_chapter, last_updated_chapter, last_summary of all that was planted; what comes before a plant is passed over."""
    rows = synced.select("book", "seq", "chapter", F.posexplode("delta.foreshadowing_ops").alias("i", "o")).select("book", "chapter", F.struct("seq", "i").alias("at"), "o.*")
    planted = F.min(F.when(F.col("action") == "plant", F.col("at"))).over(Window.partitionBy("book", "id"))
    own = rows.withColumn("_p", planted).where(F.col("at") >= F.col("_p"))
    return own.groupBy("book", "id").agg(
        F.max_by("action", "at").alias("status"), F.min_by("chapter", "at").alias("planted_chapter"), F.max_by("chapter", "at").alias("last_updated_chapter"),
        F.coalesce(F.max_by("summary", F.when(F.col("summary") != "", F.col("at"))), F.lit("")).alias("last_summary"),
    )


def knowledge_state(synced: DataFrame) -> DataFrame:
    """book, character_id, known (all ever learnt, in that order), unknown (as last stated)."""
    rows = synced.select("book", "seq", F.posexplode("delta.knowledge_boundary_updates").alias("i", "k")).select("book", F.struct("seq", "i").alias("at"), "k.*")
    learnt = rows.select("book", "character_id", "at", F.posexplode("newly_known").alias("j", "fact")).groupBy("book", "character_id", "fact").agg(F.min(F.struct("at", "j")).alias("at"))
    known = learnt.groupBy("book", "character_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "fact"))), lambda x: x["fact"]).alias("known"))
    none = F.array().cast("array<string>")
    unknown = rows.groupBy("book", "character_id").agg(F.coalesce(F.max_by("still_unknown", F.when(F.col("still_unknown").isNotNull(), F.col("at"))), none).alias("unknown"))
    return unknown.join(known, ["book", "character_id"], "left").select("book", "character_id", F.coalesce("known", none).alias("known"), "unknown")


def timeline_state(synced: DataFrame) -> DataFrame:
    """book, key, value: the last value of each key of the timelines."""
    rows = synced.select("book", "seq", F.explode("delta.timeline").alias("key", "value"))
    return rows.groupBy("book", "key").agg(F.max_by("value", "seq").alias("value"))


def age_state(synced: DataFrame) -> DataFrame:
    """book, id, age: the last table of ages that a synced delta gives."""
    ages = F.col("delta.number_anchors_updated.character_age")
    last = synced.where(ages.isNotNull()).groupBy("book").agg(F.max_by(ages, "seq").alias("ages"))
    return last.select("book", F.explode("ages").alias("id", "age"))


def due_checks(chapters: DataFrame, every: int = 5) -> DataFrame:
    """book, chapter_no, since: the chapters of ``chapters(book, chapter_no)`` at which a check is due, ``every`` and more after the last one (at first after none).

    A book's numbers meet in one array; repeated and null ones don't count.
    """
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<struct<chapter_no:bigint,since:bigint>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        fired = F.struct(c.alias("last"), F.concat(s["out"], F.array(F.struct(c.alias("chapter_no"), s["last"].alias("since")))).alias("out"))
        return F.when(c - s["last"] >= every, fired).otherwise(s)

    numbers = chapters.where("chapter_no is not null").groupBy("book").agg(F.array_sort(F.collect_set(F.col("chapter_no").cast("long"))).alias("_c"))
    return numbers.select("book", F.explode(F.aggregate("_c", start, step, lambda s: s["out"])).alias("x")).select("book", "x.*")
