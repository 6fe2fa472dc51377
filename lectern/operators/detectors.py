"""Findings on single documents: one row a finding, (doc_id, type, severity, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import Pack
from . import structure as S
from .matching import Lexicon, chosen


def graded(n: Column, advisory: float | None, blocking: float | None) -> Column:
    """Severity of a count: blocking and advisory from those values on, else null."""
    out = F.lit(None).cast("string")
    if advisory is not None:
        out = F.when(n >= advisory, F.lit("advisory")).otherwise(out)
    if blocking is not None:
        out = F.when(n >= blocking, F.lit("blocking")).otherwise(out)
    return out


def list_counts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, list, n: how often the terms of each list occur, without lists that a text has nothing of."""
    names = F.array(*map(F.lit, lexicon.lists))
    pairs = F.zip_with(names, lexicon.counts("text"), lambda k, n: F.struct(k.alias("list"), n.alias("n")))
    return docs.select("doc_id", F.explode(F.filter(pairs, lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.list", "x.n")


def long_paragraphs(docs: DataFrame, pack: Pack, limit: int = 200) -> DataFrame:
    """doc_id, line_no, n: prose lines above a length."""
    return S.narrative_lines(docs, pack).where(F.length("line") > limit).select("doc_id", "line_no", F.length("line").cast("long").alias("n"))


def repeated_images(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, term, severity, n: images on three and more lines of narrative."""
    term = F.explode(F.array(*[F.lit(t) for t in pack.lists["imagery"]]))
    rows = S.narrative_lines(docs, pack).select("doc_id", "narrative", term.alias("term")).where(F.contains("narrative", "term"))
    n = rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return n.select("doc_id", "term", graded(F.col("n"), 3, 5).alias("severity"), F.col("n").cast("long")).where("severity is not null")


def runs(rows: DataFrame, hit: Column, least: int, *by: str, order: str) -> DataFrame:
    """by, start, n: maximal runs of ``least`` and more rows in order where ``hit`` holds; other rows end a run."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w))
    return marked.where("_hit").groupBy(*by, "_run").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_run")


def short_sentence_runs(docs: DataFrame, pack: Pack, short: int = 5, least: int = 6) -> DataFrame:
    """doc_id, start (sentence), n: runs of short sentences."""
    rows = S.sentence_rows(docs, pack).where("visible > 0")
    return runs(rows, F.col("visible") <= short, least, "doc_id", order="sentence_no")


def dialogue_streaks(docs: DataFrame, pack: Pack, least: int = 6, most: int = 8) -> DataFrame:
    """doc_id, start (line), n, severity: runs of lines that are dialogue and little else, blocking from ``most`` on; a blank line ends a run."""
    rows = S.prose_lines(docs).withColumn("_q", F.col("line").rlike("[“”‘’「」『』\"]"))
    found = runs(rows, F.col("_q") & (T.visible_length(T.strip_quoted("line"), pack.visible) <= 10), least, "doc_id", order="line_no")
    return found.withColumn("severity", graded(F.col("n"), least, most))


def adjacent_repeats(docs: DataFrame, pack: Pack, least: int = 8) -> DataFrame:
    """doc_id, line_no: content lines equal to the content line before, with enough narrative."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = S.prose_lines(docs).where("not blank and line not like '#%' and line not like '---%'").withColumn("_before", F.lag("line").over(w))
    return rows.where(F.col("line") == F.col("_before")).where(T.visible_length(T.strip_quoted("line"), pack.visible) >= least).select("doc_id", "line_no")


def repeated_sentences(docs: DataFrame, pack: Pack, least: int = 12, times: int = 3) -> DataFrame:
    """doc_id, n, first_at: sentences of enough visible characters that occur three and more times."""
    rows = S.sentence_rows(docs, pack).where(F.col("visible") >= least)
    return rows.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"), F.min("sentence_no").alias("first_at")).where(F.col("n") >= times).select("doc_id", "n", "first_at")


def truncated(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, line_no: last content line without a closing mark."""
    last = S.prose_lines(docs).where("not blank and line not like '#%' and line not like '---%'").groupBy("doc_id").agg(F.max_by("line", "line_no").alias("line"), F.max("line_no").alias("line_no"))
    return last.where(~F.col("line").rlike(pack.closing + r"\z")).select("doc_id", "line_no")


def placeholders(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, line_no, pattern: the first of the ordered patterns that a line shows; soft ones don't count on lines of dialogue."""
    spoken, which = F.col("line").rlike("[\"'「」『』【】]"), F.lit(None).cast("long")
    for i, p in reversed(list(enumerate(pack.placeholders, 1))):
        hit = F.col("line").rlike(p)
        which = F.when(hit & ~spoken if i in pack.soft else hit, F.lit(i)).otherwise(which)
    return S.prose_lines(docs).select("doc_id", "line_no", which.cast("long").alias("pattern")).where("pattern is not null")


def meta_leaks(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, line_no, severity: words of the trade in the text, on dialogue lines advisory; words of the second tier are advisory anywhere.

    The first line with content may be a chapter's title and is left out then.
    """
    rows = S.prose_lines(docs).where("not blank")
    first = Window.partitionBy("doc_id").orderBy("line_no")
    told = rows.withColumn("_title", (F.row_number().over(first) == 1) & F.col("line").rlike(pack.title)).where("not _title")
    one = T.contains_any("line", pack.lists["meta_1"])
    severity = F.when(one & ~F.col("line").rlike("[\"'「」『』【】]"), "blocking").when(one | F.col("line").rlike(pack.meta_2), "advisory")
    return told.select("doc_id", "line_no", severity.alias("severity")).where("severity is not null")


def common_sets(docs: DataFrame, k: int = 20, n: int = 3) -> DataFrame:
    """doc_id, grams: the k commonest n-grams of a text's letters, as a set."""
    from .rhythm import top_ngrams

    return top_ngrams(docs, n, k).groupBy("doc_id").agg(F.array_sort(F.collect_list("gram")).alias("grams"))


def set_distance(a: str | Column, b: str | Column) -> Column:
    """Jaccard distance of two arrays as sets; two empty ones are alike."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.array().cast("array<string>")) for x in (a, b))
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / F.nullif(both, F.lit(0)))


def vocabulary_drift(docs: DataFrame, k: int = 20) -> DataFrame:
    """book, chapter_no, distance (millionths): how far a chapter's commonest n-grams are from those of the chapter before."""
    own = docs.select("source", "doc_id").join(common_sets(docs, k), "doc_id", "left")
    before = Window.partitionBy("book").orderBy("chapter_no")
    rows = S.chapters(own).withColumns({"_b": F.lag("grams").over(before), "_n": F.row_number().over(before)})
    return rows.where("_n > 1").select("book", "chapter_no", T.scaled(set_distance("grams", "_b")).alias("distance"))


def samples(found: DataFrame, *by: str, order: str, k: int = 20) -> DataFrame:
    """by, n, first: how many rows of each group there are, and the first k in order, as examples beside the count."""
    one = F.array_sort(F.collect_list(order))
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.slice(one, 1, k).alias("first"))


#: Tags of speech, suffixes of places and of things, and marks of foreshadowing.
TAGS = "说道?|道|笑道|喊道?|叫道?|问|答|怒道|冷道|低声道?|轻声道?|叹道|沉声道?|嘶声道?|冷笑道|苦笑道|微笑道|嘟囔道|嘀咕道|喃喃道"
PLACES = "城谷山河林殿阁楼院宫门派宗族镇村岛崖洞塔桥街巷府庄堂室房营寨关峡渊海湖溪泉峰岭坡原野漠泽"
THINGS = "剑刀枪弓盾铠甲杖珠玉戒链印符卷书册瓶丹药茶酒令牌镜琴笛箫鼓钟鼎炉灯伞扇帕囊袋筐箱柜床桌椅碗杯壶盘"
ENTITIES = {"character": f"([一-鿿]{{2,4}}?)(?:{TAGS})", "location": f"([一-鿿]{{2,3}}?[{PLACES}])", "item": f"([一-鿿]{{2,4}}?[{THINGS}])", "foreshadow": "(【?(?:伏笔|悬念|线索|秘密|谜团|疑问)】?)"}


def entities(docs: DataFrame, patterns: dict[str, str] = ENTITIES, stop: tuple[str, ...] = (), prefixes: str = "", known: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keyword, kind, pos: names that the patterns find; of several kinds at one place the first counts.

    Stop words are left out, and names that begin with one of ``prefixes``, unless they are known.
    """
    places = lambda p: T.spans(F.split("text", p, -1), F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    each = [places(p) for p in patterns.values()]
    rows = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), e.alias("hits")) for i, (k, e) in enumerate(zip(patterns, each, strict=True))])).alias("x"))
    rows = rows.select("doc_id", "x.i", "x.kind", F.explode("x.hits").alias("h")).select("doc_id", "i", "kind", F.col("h.pos").cast("long").alias("pos"), "h.found")
    name = F.lit(None).cast("string")
    for i, p in enumerate(patterns.values()):
        name = F.when(F.col("i") == i, F.regexp_extract("found", p, 1)).otherwise(name)
    rows = rows.withColumn("keyword", name).where(~F.col("keyword").isin(*stop) if stop else F.lit(True))
    if prefixes:
        rows = rows.where(F.col("keyword").isin(*known) | ~F.substring("keyword", 1, 1).isin(*prefixes))
    return rows.groupBy("doc_id", "keyword", "pos").agg(F.min_by("kind", "i").alias("kind")).select("doc_id", "keyword", "kind", "pos")


def category_hits(c: str, pack: Pack) -> Column:
    """Category of each longest match, left to right; excluded compounds are consumed and dropped."""
    category = {w: k for k, ws in pack.categories.items() for w in ws if w not in pack.excludes}
    return chosen(Lexicon({"": [*(w for ws in pack.categories.values() for w in ws), *pack.excludes]}).longest(c), category)


def emotion_profile(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, hits, kinds, chars and density (millionths for each 1000 characters that aren't blank)."""
    chars = F.length(F.regexp_replace("text", r"\s", ""))
    rows = docs.select("doc_id", category_hits("text", pack).alias("_h"), chars.cast("long").alias("chars"))
    return rows.select("doc_id", F.size("_h").cast("long").alias("hits"), F.size(F.array_distinct("_h")).cast("long").alias("kinds"), "chars", T.scaled(F.size("_h") * 1000.0 / F.nullif("chars", F.lit(0))).alias("density"))


def emotion_curve(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, type: thirds with the same categories, or an empty first or last third."""
    hits = lambda i: F.array_sort(F.array_distinct(F.col(f"_{i}")))
    cut = docs.select("doc_id", T.thirds("text").alias("_t")).select("doc_id", *[F.element_at("_t", i).alias(f"t{i}") for i in (1, 2, 3)])
    rows = cut.select("doc_id", *[category_hits(f"t{i}", pack).alias(f"_{i}") for i in (1, 2, 3)])
    kind = F.when((F.size("_1") == 0) | (F.size("_3") == 0), "empty-end").when((hits(1) == hits(2)) & (hits(2) == hits(3)), "flat")
    return rows.select("doc_id", kind.alias("type")).where("type is not null")


def monotone_words(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, term, severity, n: one category word five and more times."""
    lexicon = Lexicon({"": [*(w for ws in pack.categories.values() for w in ws), *pack.excludes]})
    found = F.filter(F.transform(lexicon.longest("text"), lambda x: x["term"]), lambda w: ~w.isin(*pack.excludes))
    rows = docs.select("doc_id", found.alias("_w")).select("doc_id", F.explode("_w").alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "term", graded(F.col("n"), 5, 8).alias("severity"), "n").where("severity is not null")


def anchor_delivery(docs: DataFrame, pack: Pack, anchors: DataFrame) -> DataFrame:
    """doc_id, anchor, severity: whether a document delivers the category (twice) or literal (once) that ``anchors(doc_id, anchor)`` asks for."""
    rows = docs.join(anchors, "doc_id").select("doc_id", "anchor", "text", category_hits("text", pack).alias("_h"))
    known = F.col("anchor").isin(*pack.categories)
    met = F.when(known, F.size(F.filter("_h", lambda k: k == F.col("anchor"))) >= 2).otherwise(F.contains("text", "anchor"))
    return rows.select("doc_id", "anchor", F.when(met, "info").otherwise("blocking").alias("severity"))


def slang_hits(docs: DataFrame, pack: Pack, *keep: str) -> DataFrame:
    """doc_id, keep, term, grade, pos (from 1), before (30 characters) of every occurrence; overlapping terms are all reported."""
    grade = F.create_map(*[F.lit(x) for g, terms in pack.grades.items() for t in terms for x in (t, g)])
    rows = docs.select("doc_id", *keep, Lexicon(pack.grades).around("text", 30).alias("_h")).select("doc_id", *keep, F.explode("_h").alias("x"))
    before = F.concat("x.before", F.left(F.concat("x.term", "x.after"), F.lit(30)))
    return rows.select("doc_id", *keep, "x.term", F.try_element_at(grade, F.col("x.term")).alias("grade"), F.col("x.pos").cast("long").alias("pos"), before.alias("before"))


def slang_clusters(docs: DataFrame, pack: Pack, near: int = 100) -> DataFrame:
    """doc_id, n: neighbouring hits closer than ``near`` characters."""
    w = Window.partitionBy("doc_id").orderBy("pos", "term")
    rows = slang_hits(docs, pack).withColumn("_gap", F.col("pos") - F.lag("pos").over(w))
    return rows.where(F.col("_gap") < near).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def genre_conflicts(docs: DataFrame, pack: Pack, genre: str) -> DataFrame:
    """doc_id, grade, n: hits of grades that the document's genre does not allow; unknown genres allow none."""
    allowed = F.create_map(*[F.lit(x) for g, ok in pack.genres.items() for x in (g, ",".join(ok))])
    lexicon = Lexicon(pack.grades)
    rows = docs.select("doc_id", F.coalesce(F.try_element_at(allowed, F.col(genre)), F.lit("")).alias("_ok"), lexicon.counts("text").alias("_n"))
    counts = F.array(*[F.struct(F.lit(g).alias("grade"), F.when(~F.contains("_ok", F.lit(g)), lexicon.count("_n", g)).otherwise(0).alias("n")) for g in pack.grades])
    return rows.select("doc_id", F.explode(counts).alias("x")).select("doc_id", "x.grade", "x.n").where("n > 0")


def stale_slang(docs: DataFrame, pack: Pack, grades=("B", "C"), chapters: int = 50) -> DataFrame:
    """book, n: hits of short-lived grades in books of more than ``chapters`` chapters."""
    lexicon = Lexicon({"": [w for g in grades for w in pack.grades[g]]})
    each = docs.select(F.col("source").alias("book"), lexicon.count(lexicon.counts("text"), "").alias("n"))
    rows = each.groupBy("book").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n").cast("long").alias("n"))
    return rows.where((F.col("chapters") > chapters) & (F.col("n") > 0)).select("book", "n")


def role_mismatches(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, term, pos: hits with a serious role in the 30 characters before."""
    return slang_hits(docs, pack).where(T.contains_any("before", pack.lists["roles"])).select("doc_id", "term", "pos")
