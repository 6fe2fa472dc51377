"""A positional index of names: extraction feeds postings, and grams of keywords find what holds a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .detectors import ENTITIES, entities
from .matching import Lexicon

#: Words that are no names, and characters that no found name begins with.
STOP = (
    "于是", "然后", "但是", "不过", "因为", "所以", "虽然", "尽管", "如果", "假如", "倘若", "只要", "只有", "除非", "一旦", "万一",
    "他们", "她们", "我们", "你们", "自己", "别人", "他人", "大家", "这个", "那个", "这些", "那些", "什么", "怎么", "为何", "为什么",
    "这样", "那样", "怎样", "因此", "他没", "她没", "它没", "他有", "她有", "它有", "他是", "她是", "它是", "他在", "她在", "它在",
    "他一", "她一", "它一", "他走", "她走", "它走", "他看", "她看", "它看", "他想", "她想", "它想", "他说", "她说", "它说", "他笑", "她笑", "它笑",
    "一瞬", "一刻", "一时", "一片", "一阵", "一股", "忽然", "突然", "顿时", "霎时", "瞬间", "转眼",
)
PREFIXES = "了的是在有到从去这那一不他她它我你把被让给对向为与和或及着过又再也都就才只还已将要能会可应该须得需便即则而且并其此某每各另本无非勿别莫看听想说笑走来坐站握拿放推拉打踢跑跳飞"


def postings(files: DataFrame, names: tuple[str, ...] = (), patterns: dict[str, str] = ENTITIES, stop: tuple[str, ...] = STOP, prefixes: str = PREFIXES) -> DataFrame:
    """keyword, kind, file, chapter, source, line, pos (from 1), context of every name in ``files(file, chapter, source, text)``.

    Known ``names`` are characters and count wherever they stand; of several kinds
    at one place they come first, then the patterns in their order.  The context
    is 30 characters on both sides, in one line of at most 80.
    """
    docs = files.select(F.struct("file", "chapter", "source").alias("doc_id"), "text")
    found = entities(docs, patterns, stop, prefixes, names)
    if names:
        known = Lexicon({"character": names}).hits(docs, "doc_id").select("doc_id", F.col("term").alias("keyword"), F.col("list").alias("kind"), "pos").where(~F.col("keyword").isin(*stop) if stop else F.lit(True))
        found = found.join(known.select("doc_id", "keyword", "pos"), ["doc_id", "keyword", "pos"], "left_anti").unionByName(known)
    rows = found.groupBy("doc_id").agg(F.collect_list(F.struct("keyword", "kind", "pos")).alias("hits"))
    each = rows.join(docs, "doc_id").select("doc_id", "text", F.explode("hits").alias("h"))
    start = F.greatest(F.col("h.pos") - 30, F.lit(1)).cast("int")
    around = F.substring("text", start, (F.col("h.pos") + F.length("h.keyword") + 30 - start).cast("int"))
    context = F.trim(F.regexp_replace(around, r"\r?\n", " "))
    context = F.when(F.length(context) > 80, F.concat(F.substring(context, 1, 77), F.lit("..."))).otherwise(context)
    return each.select("h.keyword", "h.kind", "doc_id.*", T.line_of("text", F.col("h.pos").cast("int")).alias("line"), "h.pos", context.alias("context"))


def _grams(word: str, n: int):
    chars = F.col(word)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(chars) - (n - 1), F.lit(1))), lambda i: F.substring(chars, i, F.lit(n))))


def keyword_grams(index: DataFrame) -> DataFrame:
    """gram, keyword: each keyword of an index under its characters and pairs of characters."""
    words = index.select("keyword").where("keyword <> ''").distinct()
    return words.select("keyword", F.explode(F.array_distinct(F.concat(_grams("keyword", 1), _grams("keyword", 2)))).alias("gram"))


def matching_keywords(queries: DataFrame, grams: DataFrame) -> DataFrame:
    """query, keyword, exact: keywords that are, hold, or are held by each of ``queries(query)``.

    A keyword that holds a query has the query's rarest pair of characters among
    its grams; one that it holds is a piece of it.  Both are equality joins, so no
    keyword is compared that shares nothing with the query.
    """
    asked = queries.select("query").where("query <> ''").distinct()
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    pairs = asked.select("query", F.explode(F.when(F.length("query") == 1, F.array("query")).otherwise(_grams("query", 2))).alias("gram")).join(df, "gram", "left")
    # a pair that no keyword has leaves nothing to hold the query
    rare = pairs.groupBy("query").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    above = rare.join(grams, "gram").where(F.contains("keyword", F.col("query"))).select("query", "keyword")
    words = grams.select("keyword").distinct()
    sizes = [r[0] for r in words.select(F.length("keyword").alias("n")).distinct().orderBy("n").collect()]  # lengths of keywords, a few numbers
    pieces = asked.select("query", F.explode(F.array_distinct(F.flatten(F.array(*[_grams("query", n) for n in sizes])))).alias("keyword")) if sizes else asked.select("query", F.col("query").alias("keyword"))
    below = pieces.join(words, "keyword").select("query", "keyword")
    return above.unionByName(below).distinct().select("query", "keyword", (F.col("query") == F.col("keyword")).alias("exact"))


def look_up(queries: DataFrame, index: DataFrame, grams: DataFrame) -> DataFrame:
    """query, exact and the postings of the keywords that match."""
    return matching_keywords(queries, grams).join(index, "keyword")
