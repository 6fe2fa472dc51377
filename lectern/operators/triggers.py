"""What a project loads when: conditions as rows, met by equality joins.

Every trigger is keyed by one thing that it asks for, and every context by all
that it has, so a pair is made only where a key is shared.  Ranges of chapters are
keyed by blocks of about their own length, of which a chapter is in one for each
length.  There is no limit to either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 32


def _key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), value.cast("string"))


def _blocks(lo: Column, hi: Column) -> Column:
    """Keys of up to three blocks of one power of two, at most the length of the range, that cover it; none for an empty range."""
    level = F.least(F.greatest(F.floor(F.log2((hi - lo + 1).cast("double"))), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    shift = lambda c: F.floor(c / F.pow(F.lit(2.0), level)).cast("long")
    return F.when(hi >= lo, F.transform(F.sequence(shift(lo), shift(hi)), lambda b: F.concat_ws(":", F.lit("chapter"), level, b)))


def _levels(chapter: Column) -> Column:
    """Keys of the block of each length that a chapter is in."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.concat_ws(":", F.lit("chapter"), k, F.floor(chapter / F.pow(F.lit(2.0), k)).cast("long")))


def met(triggers: DataFrame, contexts: DataFrame, salts: int = 16) -> DataFrame:
    """Pairs of ``triggers(_keys, ..)`` and ``contexts(id, _keys, ..)`` with a key in common.

    A key that all contexts have is dealt out: contexts to one of ``salts`` parts each, triggers to all.
    """
    t = triggers.withColumn("_key", F.explode("_keys")).drop("_keys").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    c = contexts.withColumn("_key", F.explode("_keys")).drop("_keys").withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return c.join(t, ["_key", "_salt"]).drop("_key", "_salt")


def triggered(triggers: DataFrame, context: DataFrame) -> DataFrame:
    """id, trigger of each row of ``context(id, genre, step, chapter, tags)`` and each of ``triggers(trigger, kind, value, lo, hi)`` that fires for it.

    Kinds are genre, step, tag, chapters (lo to hi) and always; rows of other kinds never fire.
    """
    kind = F.col("kind")
    keys = F.when(kind.isin("genre", "step", "tag"), F.array(F.concat_ws(":", kind, "value"))).when(kind == "chapters", _blocks(F.col("lo"), F.col("hi"))).when(kind == "always", F.array(F.lit("any")))
    t = triggers.where("kind in ('always', 'chapters') or value is not null").select("trigger", "kind", "lo", "hi", F.coalesce(keys, F.array().cast("array<string>")).alias("_keys"))
    own = F.concat(F.array(F.lit("any"), _key("genre", F.col("genre")), _key("step", F.col("step"))), F.transform(F.coalesce(F.array_distinct("tags"), F.array().cast("array<string>")), lambda x: _key("tag", x)), F.coalesce(_levels(F.col("chapter")), F.array().cast("array<string>")))
    c = context.select("id", "chapter", F.filter(own, lambda k: k.isNotNull()).alias("_keys"))
    return met(t, c).where("kind <> 'chapters' or chapter between lo and hi").select("id", "trigger")


def parsed(triggers: DataFrame) -> DataFrame:
    """``triggers(trigger, section, condition)`` with what its condition asks for in columns.

    scenes, scene (one), tag, ratio, genres and step are null where they are not
    asked for; asks_* say that a value must be there at all.  Several genres, with
    ``or`` or ``in``, are alternatives.
    """
    c, low = F.coalesce("condition", F.lit("")), F.lower(F.coalesce("condition", F.lit("")))
    always = (c == "") | (c == "always")
    has = lambda word: ~always & F.contains(low, F.lit(word))
    got = lambda p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    members = lambda s: F.filter(F.transform(F.split(F.regexp_replace(s, "[\\[\\]\"'“”]", ""), r"\s*(?:[,，]|\bor\b)\s*"), F.trim), lambda x: x != "")
    planning, stepped = F.contains("section", F.lit("02a")), F.contains("section", F.lit("步骤触发集"))
    return triggers.select(
        "trigger", "section", "condition",
        has("scene_type").alias("asks_scene"), F.when(has("scene_type"), F.transform(F.split(got(r"(?i)scene_type\s*(?:in\s*)?\[([^\]]+)\]"), ","), lambda x: F.lower(F.trim(x)))).alias("scenes"), F.when(has("scene_type"), F.lower(got(r"(?i)scene_type\s*==\s*(\w+)"))).alias("scene"),
        has("内容标签").alias("asks_tag"), F.when(has("内容标签"), got(r"内容标签\s*[=＝]\s*(\S+)")).alias("tag"),
        has("dialogue_ratio").alias("asks_ratio"), F.when(has("dialogue_ratio"), got(r"(?i)dialogue_ratio\s*>\s*(\d+)").cast("long")).alias("ratio"),
        has("新角色").alias("asks_new"), F.when(~always & stepped, F.lower(got(r"^(\d+[a-z]?)\s"))).alias("step"),
        has("genre").alias("asks_genre"), F.when(has("genre"), members(got(r"(?i)genre\s*(?:==|in)\s*(.*?)(?:\s+and\s|$)"))).alias("genres"),
        (~always & planning).alias("planning"), (planning & (has("首批建纲") | has("前10章"))).alias("early"), (planning & has("滚动补纲")).alias("later"),
        F.when(planning & has("卷首章"), "opening").alias("opening"), F.when(planning & has("高潮章"), "climax").alias("climax"), (planning & has("发现细纲变对话脚本")).alias("by_hand"),
    )


def loaded(triggers: DataFrame, contexts: DataFrame) -> DataFrame:
    """id, trigger: what the conditions of ``triggers(trigger, section, condition)`` load for each row of ``contexts``.

    ``contexts(id, scene, content_tag, dialogue_ratio, new_character, step, genre,
    chapter, chapter_type)``; nulls are values that are not known, and no condition
    that asks for one holds then.  A condition is keyed by its genres, or else its
    scenes, its step, or by nothing.
    """
    rows = parsed(triggers).where(~F.col("by_hand"))
    keyed = lambda kind, values: F.transform(values, lambda v: _key(kind, v))
    scenes = F.when(F.col("scenes").isNotNull(), F.array_distinct("scenes")).when(F.col("scene").isNotNull(), F.array("scene"))
    keys = F.coalesce(F.when(F.size(F.coalesce("genres", F.array().cast("array<string>"))) > 0, keyed("genre", F.array_distinct("genres"))), keyed("scene", scenes), F.when(F.col("planning"), F.array(F.lit("step:02a"))), F.when(F.col("step").isNotNull(), F.array(_key("step", F.col("step")))), F.array(F.lit("any")))
    step, scene = F.lower("c_step"), F.lower("c_scene")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(step), F.lit(1))), lambda n: _key("step", F.substring(step, F.lit(1), n)))
    own = F.concat(F.array(F.lit("any"), _key("genre", F.col("c_genre")), _key("scene", scene)), F.coalesce(starts, F.array().cast("array<string>")))
    c = contexts.select("id", *[F.col(x).alias(f"c_{x}") for x in ("scene", "content_tag", "dialogue_ratio", "new_character", "step", "genre", "chapter", "chapter_type")])
    pairs = met(rows.withColumn("_keys", keys), c.withColumn("_keys", F.array_distinct(F.filter(own, lambda k: k.isNotNull()))))
    holds = [
        ~F.col("asks_scene") | F.col("c_scene").isNotNull(), F.col("scenes").isNull() | F.array_contains("scenes", scene), F.col("scene").isNull() | (F.col("scene") == scene),
        ~F.col("asks_tag") | (F.coalesce("c_content_tag", F.lit("")) != ""), F.col("tag").isNull() | F.contains("c_content_tag", "tag"),
        ~F.col("asks_ratio") | F.col("c_dialogue_ratio").isNotNull(), F.col("ratio").isNull() | (F.col("c_dialogue_ratio") > F.col("ratio")),
        ~F.col("asks_new") | F.col("c_new_character"), F.col("step").isNull() | F.startswith(step, F.col("step")),
        ~F.col("asks_genre") | F.col("c_genre").isNotNull(), F.col("genres").isNull() | (F.size("genres") == 0) | F.array_contains("genres", F.col("c_genre")),
        ~F.col("planning") | (step == "02a"), ~F.col("early") | (F.col("c_chapter") <= 10), ~F.col("later") | (F.col("c_chapter") > 10),
        F.col("opening").isNull() | (F.col("c_chapter_type") == "opening"), F.col("climax").isNull() | (F.col("c_chapter_type") == "climax"),
    ]
    for h in holds:
        pairs = pairs.where(F.coalesce(h, F.lit(False)))
    return pairs.select("id", "trigger")
