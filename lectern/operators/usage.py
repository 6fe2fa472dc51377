"""What the chapters of a book use again and again: patterns of sentences and bodies, images, punctuation and the lengths of sentences.

Everything of a chapter is counted inside its row; a book's roll-up adds the few
numbers of its chapters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .structure import spread

#: 16 patterns of sentences and 9 of bodies, by their labels.
ZH_BANK = {
    "sentence": {
        "不是A是B": r"不是[^，。！？\n]{1,40}[，,]?\s*而是",
        "仿佛…（一般）": r"仿佛[^，。！？\n]{2,25}",
        "如同…": r"如同[^，。！？\n]{2,25}",
        "宛若…": r"宛若[^，。！？\n]{2,20}",
        "心中一紧/颤/凉": "心中一[紧颤凉]",
        "倒吸凉气": "倒吸(?:一口)?凉气",
        "握紧拳头": "握紧(?:了)?拳头",
        "心跳加速": "心跳(?:加速|加快|如鼓|如雷)",
        "眼神冰冷/锐利": "眼神(?:冰冷|凛冽|锐利|如刀)",
        "眉头紧锁/一皱": "眉头(?:紧锁|一皱|微皱)",
        "嘴角上扬/勾起": "嘴角(?:上扬|微扬|勾起|抽搐)",
        "声音沙哑/低沉": "声音(?:沙哑|嘶哑|低沉|冰冷)",
        "陷入沉默": "(?:空气|氛围|场面)?(?:瞬间)?(?:陷入)?沉默",
        "时间静止": "(?:时间|空间)(?:仿佛)?(?:瞬间)?(?:静止|停滞|凝固)",
        "风吹过…": r"风吹过[^，。！？\n]{0,15}",
        "月光洒/照": "月光(?:洒|照|映|落)",
    },
    "body": {
        "握拳": "握(?:紧|住)?(?:了)?(?:拳头|双拳)",
        "颤抖": "(?:身体|手|腿)?(?:微微)?(?:发抖|颤抖|哆嗦)",
        "冷汗": "(?:冷汗|汗珠)(?:冒出|滚落|流下|渗出)",
        "脸色苍白": "(?:脸色|面色)(?:苍白|发白|惨白)",
        "脸色涨红": "(?:脸色|面色|脸)(?:涨红|通红|发红)",
        "吸气": "(?:倒吸|深吸)(?:一口)?(?:凉气|冷气|气)",
        "踉跄后退": "(?:踉跄|趔趄|后退(?:几步|两步))",
        "瞳孔放大": "(?:瞳孔|眼睛|双目)(?:放大|睁大|一缩)",
        "咬牙": "咬(?:紧|住)?(?:牙关|嘴唇|下唇)",
    },
}
#: Images of surroundings.
ZH_IMAGES = (
    "月光", "阳光", "星光", "灯光", "火光", "风", "雨", "雪", "雾", "云", "血", "泪", "汗", "剑", "刀", "拳", "掌",
    "墙", "门", "窗", "桌", "椅", "茶", "酒", "药", "路", "桥", "河", "山", "树",
)
#: A harness for Latin-script corpora.
LATIN_BANK = {"sentence": {"number": "[0-9]{4,}", "token": 'token = "[0-9a-z]+', "either": "not? [^,.!?\n]{1,40},? but"}, "body": {"hand": "(?:left|right)? ?hands?", "shout": "[A-Z]{3,}!*"}}
MARKS = {"ellipsis": "…", "dash": "——", "exclaim": "[！!]", "question": "[？?]", "comma": "[，,]", "period": "[。.]"}


def body_of(text: str | Column) -> Column:
    """What the chapter's tag holds, or the whole text; empty for a null one."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    tag = "(?s)<chapter_content>(.*?)</chapter_content>"
    return F.when(text.rlike(tag), F.regexp_extract(text, tag, 1)).otherwise(text)


def pattern_places(docs: DataFrame, bank: dict[str, dict[str, str]]) -> DataFrame:
    """book, doc_id, kind, label, n, examples (the first three): what each chapter of ``docs(source, doc_id, text)`` has of a bank of patterns, from one pass."""

    def found(kind: str, label: str, pattern: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.regexp_extract_all("_body", F.lit(pattern), F.lit(0)).alias("found"))

    every = F.array(*[found(k, label, p) for k, ps in bank.items() for label, p in ps.items()])
    rows = docs.select(F.col("source").alias("book"), "doc_id", body_of("text").alias("_body")).select("book", "doc_id", F.explode(F.filter(every, lambda x: F.size(x["found"]) > 0)).alias("x"))
    return rows.select("book", "doc_id", "x.kind", "x.label", F.size("x.found").cast("long").alias("n"), F.slice("x.found", 1, 3).alias("examples"))


def pattern_usage(docs: DataFrame, bank: dict[str, dict[str, str]]) -> DataFrame:
    """book, kind, label, total, chapters of all chapters of a book."""
    return pattern_places(docs, bank).drop("examples").groupBy("book", "kind", "label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("chapters"))


def image_usage(docs: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """book, word, total of the images that a book has."""
    body = docs.select(F.col("source").alias("book"), body_of("text").alias("_body"))
    each = F.array(*[F.struct(F.lit(w).alias("word"), T.count_literal("_body", w).alias("n")) for w in words])
    rows = body.select("book", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("x"))
    return rows.groupBy("book", "x.word").agg(F.sum("x.n").alias("total"))


def chapter_rhythm(docs: DataFrame) -> DataFrame:
    """book, doc_id, chars, sentences, mean (tenths), burstiness (thousandths) and the marks of each chapter; without sentences zeros."""
    rows = docs.select(F.col("source").alias("book"), "doc_id", body_of("text").alias("_body"))
    rows = rows.select("*", F.transform(T.kept_sentences("_body"), lambda s: F.length(s)).alias("_v"))
    n, mean, variation = spread(F.col("_v"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select(
        "book", "doc_id", F.length("_body").cast("long").alias("chars"), n.cast("long").alias("sentences"), zero(T.scaled(mean, 10)).alias("mean"), zero(T.scaled(variation, 1000)).alias("burstiness"),
        *[T.count_matches("_body", p).alias(k) for k, p in MARKS.items()],
    )


def book_rhythm(docs: DataFrame, least: int = 350) -> DataFrame:
    """book, chapters, chars, the means over chapters (tenths) of marks, burstiness and sentence length, and whether a chapter has a burstiness (thousandths) under ``least``."""
    rows = chapter_rhythm(docs)
    mean = lambda c, by: T.scaled(F.sum(c).cast("double") / F.count(F.lit(1)) / by, 10)
    return rows.groupBy("book").agg(
        F.count(F.lit(1)).alias("chapters"), F.sum("chars").alias("chars"), *[mean(k, 1.0).alias(k) for k in MARKS], mean("burstiness", 1000.0).alias("burstiness"), mean("mean", 10.0).alias("mean_length"), (F.min("burstiness") < least).alias("warning")
    )


def too_short(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, type, severity, n of texts with fewer than ``least`` characters, but for blanks and marks of Markdown: too short to measure emotions."""
    bare = F.replace(F.regexp_replace(F.regexp_replace("text", "(?s)```.*?```", ""), r"#{1,6}\s", ""), F.lit("**"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.length(F.regexp_replace(bare, r"\s", "")), F.lit(0)).cast("long").alias("n")).where(F.col("n") < least)
    return rows.select("doc_id", F.lit("too-short").alias("type"), F.lit("advisory").alias("severity"), "n")
