"""Analyses across the chapters of a book.  A book is a partition; only its order is a window."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import Pack
from . import detectors as D
from . import structure as S
from .matching import once


def _gaps(docs: DataFrame, terms, least: int) -> DataFrame:
    rows = S.chapters(docs.select("source", "doc_id", T.contains_any("text", terms).alias("_has")))
    return D.runs(rows, ~F.col("_has"), least, "book", order="chapter_no")


def reward_gaps(docs: DataFrame, pack: Pack, least: int = 3) -> DataFrame:
    """book, start, n, severity: runs of chapters without a reward term; blocking from five on."""
    return _gaps(docs, pack.lists["reward"], least).withColumn("severity", F.when(F.col("n") >= 5, "blocking").otherwise("advisory"))


def flat_emotion(docs: DataFrame, pack: Pack, least: int = 3) -> DataFrame:
    """book, start, n: runs of chapters without an emotion term."""
    return _gaps(docs, pack.lists["feeling"], least)


def ratio_imbalance(docs: DataFrame, pack: Pack, support: int = 5) -> DataFrame:
    """book, hits, total, severity: share of foreshadowing terms above 20 % or under 5 %."""
    parts = {c: T.count_terms("text", pack.lists[c]) for c in ("plot", "character", "foreshadow")}
    rows = docs.groupBy(F.col("source").alias("book")).agg(*[F.sum(c).cast("long").alias(k) for k, c in parts.items()])
    rows = rows.select("book", F.col("foreshadow").alias("hits"), (F.col("plot") + F.col("character") + F.col("foreshadow")).alias("total")).where(F.col("total") >= support)
    return rows.where("hits * 5 > total or hits * 20 < total")


def missing_hooks(docs: DataFrame, pack: Pack, tail: int = 500) -> DataFrame:
    """book, chapter_no: chapters whose last characters hold no hook."""
    hook = T.contains_any(F.expr(f"right(text, {tail})"), pack.lists["hooks"])
    return S.chapters(docs.select("source", "doc_id", hook.alias("_hook"))).where("not _hook").select("book", "chapter_no")


def sentence_variance(docs: DataFrame, pack: Pack, least: int = 10, limit: float = 8.0) -> DataFrame:
    """book, chapter_no, deviation (millionths) of chapters with enough sentences and little variation."""
    v = F.transform(T.sentences("text", pack.ends), lambda s: T.visible_length(s, pack.visible))
    n, mean, cv = S.spread(F.col("_v"))
    each = docs.select("source", "doc_id", F.filter(v, lambda x: x > 0).alias("_v")).select("source", "doc_id", n.alias("_n"), (cv * mean).alias("_s"))
    return S.chapters(each).where((F.col("_n") >= least) & (F.col("_s") < limit)).select("book", "chapter_no", T.scaled(F.col("_s"), 1e3).alias("deviation"))


def mean_sentence(docs: DataFrame, pack: Pack) -> DataFrame:
    """book, chapter_no, mean visible length of sentences; 0 without sentences."""
    v = F.filter(F.transform(T.sentences("text", pack.ends), lambda s: T.visible_length(s, pack.visible)), lambda x: x > 0)
    _, mean, _ = S.spread(F.col("_v"))
    each = docs.select("source", "doc_id", v.alias("_v")).select("source", "doc_id", F.coalesce(mean, F.lit(0.0)).alias("mean"))
    return S.chapters(each).select("book", "chapter_no", "mean")


def rhythm_collapse(docs: DataFrame, pack: Pack, fall: float = 0.3) -> DataFrame:
    """book, chapter_no: where the mean of three chapters is 30 % under that of the three before; after a hit three are skipped.

    The means are windows; only the skipping folds a book's few candidates, and
    those hold a number a chapter.
    """
    w = Window.partitionBy("book").orderBy("chapter_no")
    rows = mean_sentence(docs, pack).select(
        "book", "chapter_no",
        F.sum("mean").over(w.rowsBetween(-3, -1)).alias("_a"), F.sum("mean").over(w.rowsBetween(0, 2)).alias("_b"),
        F.count("mean").over(w.rowsBetween(-3, -1)).alias("_n"), F.count("mean").over(w.rowsBetween(0, 2)).alias("_m"),
    )
    hits = rows.where((F.col("_n") == 3) & (F.col("_m") == 3) & (F.col("_a") > 0) & (F.col("_b") < F.col("_a") * (1 - fall)))
    greedy = F.aggregate(
        F.array_sort(F.collect_list("chapter_no")),
        F.array().cast("array<bigint>"),
        lambda out, c: F.when((F.size(out) == 0) | (c >= F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + 3), F.concat(out, F.array(c))).otherwise(out),
    )
    return hits.groupBy("book").agg(greedy.alias("_c")).select("book", F.explode("_c").alias("chapter_no"))


def opener_grams(text: str | Column, head: int = 200, first: int = 10, n: int = 4) -> Column:
    return F.array_distinct(F.slice(T.char_ngrams(F.substring(text, 1, head), n), 1, first))


def opener_duplicates(docs: DataFrame, pack: Pack, least: int = 3, n: int = 4, block: int = 1000) -> DataFrame:
    """book, a, b, shared, severity: chapters of a book whose openings share ``least`` and more n-grams.

    Chapters with the same n-grams are one class, named by its n-grams end to end.
    Classes meet on an n-gram, and a pair counts where it is the first that it
    shares; the last ``least - 1`` of a class are never the first.  All this is in
    the join's condition, so that what is shuffled grows with the classes and the
    result.  Only that is expanded, from blocks of a class's chapters; it has a row
    for each pair, so a book whose chapters all begin alike has all its pairs.
    """
    each = docs.select("source", "doc_id", F.array_sort(opener_grams("text", n=n)).alias("_g"))
    rows = S.chapters(each).where(F.col("book").isNotNull() & (F.size("_g") >= least)).withColumn("key", F.array_join("_g", ""))
    sets = rows.select("book", "key", "_g").distinct()
    met = sets.select("book", "key", "_g", F.explode(F.slice("_g", F.lit(1), F.size("_g") - (least - 1))).alias("gram"))
    x, y = met.alias("x"), met.alias("y")
    common = F.array_intersect("x._g", "y._g")
    on = (F.col("x.book") == F.col("y.book")) & (F.col("x.gram") == F.col("y.gram")) & (F.col("x.key") < F.col("y.key")) & (F.size(common) >= least) & (F.get(common, F.lit(0)) == F.col("x.gram"))
    alike = x.join(y, on).select(F.col("x.book").alias("book"), F.col("x.key").alias("key"), F.col("y.key").alias("other"), F.size(common).cast("long").alias("shared"))
    members = rows.groupBy("book", "key", F.floor(F.col("chapter_no") / block).alias("block")).agg(F.collect_list("chapter_no").alias("_c"))
    second = members.select("book", F.col("key").alias("other"), F.col("block").alias("_b"), F.col("_c").alias("_d"))
    across = alike.join(members, ["book", "key"]).join(second, ["book", "other"]).select("book", "shared", "_c", "_d", F.lit(False).alias("_own"))
    own = (F.length("key") / n).cast("long").alias("shared")
    within = members.join(second.withColumnRenamed("other", "key"), ["book", "key"]).where("block <= _b").select("book", own, "_c", "_d", (F.col("block") == F.col("_b")).alias("_own"))
    pairs = across.unionByName(within).select("book", "shared", "_own", F.explode("_c").alias("_x"), "_d").select("book", "shared", "_own", "_x", F.explode("_d").alias("_y"))
    pairs = pairs.where(~F.col("_own") | (F.col("_x") < F.col("_y")))  # a block with itself has each pair twice
    found = pairs.select("book", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "shared")
    return found.withColumn("severity", F.when(F.col("shared") >= 5, "blocking").otherwise("advisory"))


def top_ngrams(docs: DataFrame, n: int = 3, k: int = 50, least: int = 3, chars: str = "[^A-Za-z]") -> DataFrame:
    """doc_id, gram, n, rank: the commonest n-grams of each row's letters; ties keep the order of first appearance.

    A text's n-grams are counted inside its row, so that nothing is shuffled; a
    task holds those of one text at a time.
    """

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            counts = Counter(map("".join, zip(*(t[i:] for i in range(n)), strict=False))) if t else Counter()
            best = [(g, c) for g, c in counts.most_common(k) if c >= least]
            out.append([{"gram": g, "n": c, "rank": r} for r, (g, c) in enumerate(best, 1)])
        return pa.array(out, pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64()), ("rank", pa.int64())])))

    found = once(of, "array<struct<gram:string,n:bigint,rank:bigint>>")(F.regexp_replace("text", chars, ""))
    return docs.select("doc_id", found.alias("_g")).select("doc_id", F.explode("_g").alias("x")).select("doc_id", "x.gram", "x.n", "x.rank")


def shared_ngrams(docs: DataFrame, k: int = 20) -> DataFrame:
    """gram, docs, n: top n-grams of two and more documents, those of the most documents first (a report of k rows)."""
    rows = top_ngrams(docs, k=50).groupBy("gram").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).where("docs >= 2")
    return rows.orderBy(F.desc("docs"), F.desc("n"), "gram").limit(k)


def style_fingerprint(docs: DataFrame, pack: Pack) -> DataFrame:
    """book, chapter_no and four ratios in millionths: sentence variation, dialogue lines, commas and full stops a visible character."""
    v = F.filter(F.transform(T.sentences("text", pack.ends), lambda s: T.visible_length(s, pack.visible)), lambda x: x > 0)
    _, _, cv = S.spread(F.col("_v"))
    ls = F.filter(F.transform(F.split("text", r"\r?\n", -1), T.jtrim), lambda x: x != "")
    said = F.size(F.filter(F.col("_l"), lambda x: x.rlike("[“”‘’「」『』\"]")))
    rows = docs.select("source", "doc_id", "text", v.alias("_v"), ls.alias("_l"))
    part = lambda x, y: T.scaled(F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0)))
    seen = T.visible_length("text", pack.visible)
    each = rows.select("source", "doc_id", T.scaled(F.coalesce(cv, F.lit(0.0))).alias("variation"), part(said, F.size("_l")).alias("dialogue"), part(T.count_matches("text", "[,，]"), seen).alias("commas"), part(T.count_matches("text", "[.。]"), seen).alias("stops"))
    return S.chapters(each).drop("doc_id")


def style_drift(docs: DataFrame, pack: Pack, limit: float = 0.3) -> DataFrame:
    """book, chapter_no, distance (millionths): adjacent chapters whose fingerprints differ by more than ``limit``."""
    w = Window.partitionBy("book").orderBy("chapter_no")
    names, weights = ("variation", "dialogue", "commas", "stops"), (0.3, 0.25, 0.25, 0.2)
    rows = style_fingerprint(docs, pack).select("*", *[F.lag(c).over(w).alias(f"_{c}") for c in names])
    far = F.lit(0.0)
    for c, x in zip(names, weights, strict=True):
        far = far + F.lit(x) * F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) / F.nullif(F.greatest(c, f"_{c}"), F.lit(0)), F.lit(0.0))
    return rows.where("_variation is not null").select("book", "chapter_no", T.scaled(far).alias("distance")).where(F.col("distance") > int(limit * 1e6))


def chapter_gaps(chapters: DataFrame) -> DataFrame:
    """book, after, before: neighbours of a gap in the chapter numbers of ``chapters(book, chapter_no)``."""
    w = Window.partitionBy("book").orderBy("chapter_no")
    rows = chapters.select("book", "chapter_no").distinct().withColumn("after", F.lag("chapter_no").over(w))
    return rows.where(F.col("chapter_no") - F.col("after") > 1).select("book", "after", F.col("chapter_no").alias("before"))


def volumes(docs: DataFrame, size: int = 10, audit: int = 3) -> DataFrame:
    """book, volume, chapters, chars, to_audit: chapters by tens, and how many until the next audit."""
    each = S.chapters(docs.select("source", "doc_id", F.length("text").alias("_n")))
    rows = each.groupBy("book", F.ceil(F.col("chapter_no") / size).cast("long").alias("volume")).agg(F.count(F.lit(1)).alias("chapters"), F.sum("_n").cast("long").alias("chars"))
    return rows.withColumn("to_audit", ((audit - F.col("volume") % audit) % audit).cast("long"))


def latest(docs: DataFrame, n: int = 5) -> DataFrame:
    """book, chapter_no, doc_id of the last n chapters of each book."""
    w = Window.partitionBy("book").orderBy(F.desc("chapter_no"))
    return S.chapters(docs.select("source", "doc_id")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("book", "chapter_no", "doc_id")


def used_patterns(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """book, label, total, chapters: matches of labelled patterns, and the chapters that have one."""
    counts = F.array(*[F.struct(F.lit(label).alias("label"), T.count_matches("text", p).alias("n")) for label, p in patterns.items()])
    out = docs.select(F.col("source").alias("book"), F.explode(counts).alias("x")).select("book", "x.*").where("n > 0")
    return out.groupBy("book", "label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("chapters"))


def punctuation(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of eight classes of punctuation."""
    classes = {"commas": "[,，]", "stops": "[.。]", "questions": "[?？]", "shouts": "[!！]", "colons": "[:：]", "semicolons": "[;；]", "dashes": "——|—|--+", "ellipses": "…+|\\.{3,}"}
    return docs.select("doc_id", *[T.count_matches("text", p).alias(k) for k, p in classes.items()])


def voice_profiles(turns: DataFrame, pack: Pack, *speaker: str, tokens: str = "[A-Za-z0-9]+|[一-鿿]") -> DataFrame:
    """speaker and ``voice``: eight ratios of all that a speaker says in ``turns(*speaker, text)``.

    Distinct tokens, mean sentence (of 50), particles (of 10 a hundred), short,
    middle and long sentences, questions, exclamations.  Counts are summed for
    each turn before a speaker's turns meet; only distinct tokens need a second
    grouping.
    """
    rows = turns.select(*speaker, F.coalesce("text", F.lit("")).alias("text"))
    v = F.filter(F.transform(T.sentences("text", pack.ends), lambda s: T.visible_length(s, pack.visible)), lambda x: x > 0)
    words = F.regexp_extract_all("text", F.lit(tokens), F.lit(0))
    each = rows.select(
        *speaker, T.visible_length("text", pack.visible).alias("chars"), T.count_terms("text", pack.lists["particles"]).alias("particles"),
        F.col("text").rlike("[？?]").cast("long").alias("asks"), F.col("text").rlike("[！!]").cast("long").alias("shouts"), v.alias("v"), F.size(words).alias("tokens"),
    )
    long_ = lambda f: F.size(F.filter("v", f))
    sums = each.groupBy(*speaker).agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("particles").alias("particles"), F.sum("asks").alias("asks"), F.sum("shouts").alias("shouts"), F.sum("tokens").alias("tokens"),
        F.sum(F.size("v")).alias("sentences"), F.sum(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)).alias("length"),
        F.sum(long_(lambda x: x <= 10)).alias("short"), F.sum(long_(lambda x: (x > 10) & (x <= 25))).alias("middle"), F.sum(long_(lambda x: x > 25)).alias("long"),
    )
    kinds = rows.select(*speaker, F.explode(words).alias("w")).groupBy(*speaker).agg(F.countDistinct("w").alias("kinds"))
    part = lambda a, b: F.coalesce(F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    voice = F.array(
        part("kinds", "tokens"), F.least(part("length", "sentences") / 50, F.lit(1.0)), F.least(part("particles", "chars") * 100 / 10, F.lit(1.0)),
        part("short", "sentences"), part("middle", "sentences"), part("long", "sentences"), part("asks", "n"), part("shouts", "n"),
    )
    return sums.join(kinds, list(speaker), "left").select(*speaker, F.when(F.col("chars") > 0, voice).otherwise(F.array_repeat(F.lit(0.0), 8)).alias("voice"))


def similar_voices(profiles: DataFrame, within: str, name: str, limit: float = 0.7) -> DataFrame:
    """within, a, b, similarity (millionths), flagged: pairs of speakers of one conversation or book."""
    x, y = profiles.alias("x"), profiles.alias("y")
    pairs = x.join(y, (F.col(f"x.{within}") == F.col(f"y.{within}")) & (F.col(f"x.{name}") < F.col(f"y.{name}")))
    rows = pairs.select(F.col(f"x.{within}").alias(within), F.col(f"x.{name}").alias("a"), F.col(f"y.{name}").alias("b"), T.scaled(T.cosine(F.col("x.voice"), F.col("y.voice"))).alias("similarity"))
    return rows.withColumn("flagged", F.col("similarity") > int(limit * 1e6))


#: Verbs of speech.
SPEECH = "说|道|问|答|叫|喊|嚷|骂|笑|叹|怒|吼|喝|回|低声道|轻声说|喃喃道|低语|呢喃|冷声道|沉声道|怒道|笑道|哭道|喊道|问道|答道|叫道"


def speakers(docs: DataFrame, names: list[str], speech: str = SPEECH) -> DataFrame:
    """doc_id, line_no, said, speaker: dialogue spans given to the speaker named before, else behind, else the only one before.

    Of several names the first in the list wins.
    """
    pattern = "[“\"]([^”\"]*)[”\"]|[「『]([^」』]*)[」』]"
    rows = S.lines(docs).select("doc_id", "line_no", T.jtrim("line").alias("line"))
    spans = rows.select("doc_id", "line_no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("_i", "span"))
    # the text before the k-th span: what k splits by the pattern leave
    pieces = F.split("line", pattern, -1)
    whole = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
    before = F.aggregate(F.arrays_zip(F.slice(pieces, F.lit(1), F.col("_i") + 1).alias("p"), F.concat(F.array(F.lit("")), F.slice(whole, F.lit(1), F.col("_i"))).alias("s")), F.lit(""), lambda acc, z: F.concat(acc, z["s"], z["p"]))
    cut = spans.select("doc_id", "line_no", "span", before.alias("before"), "line").withColumn("after", F.expr("substring(line, length(before) + length(span) + 1)"))
    who = {t: F.lit(None).cast("string") for t in ("tag", "tail", "only")}
    for n in reversed(names):
        others = T.contains_any("before", [m for m in names if m != n]) if len(names) > 1 else F.lit(False)
        who["tag"] = F.when(F.col("before").rlike(rf"{n}\s*(?:{speech})\s*[：:。！？]?\s*\z") | F.col("before").rlike(rf"{n}[^，。！？\n]{{0,10}}(?:{speech})\s*[：:]?\s*\z"), F.lit(n)).otherwise(who["tag"])
        who["tail"] = F.when(F.col("after").rlike(rf"^[，。！？]?\s*{n}\s*(?:{speech})"), F.lit(n)).otherwise(who["tail"])
        who["only"] = F.when(F.contains("before", F.lit(n)) & ~others, F.lit(n)).otherwise(who["only"])
    said = F.expr("substring(span, 2, length(span) - 2)")
    return cut.select("doc_id", "line_no", said.alias("said"), F.coalesce(*who.values()).alias("speaker")).where("speaker is not null and said <> ''")
