"""From documents to chapters, lines, prose lines and sentences."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import Pack
from .matching import once


def chapters(rows: DataFrame) -> DataFrame:
    """book, chapter_no and the other columns of ``rows(source, doc_id, ..)``: a source is a book, its documents in order of doc_id are chapters.

    A book's rows meet in a window, so they should hold what was measured of a text, not the text.
    """
    order = Window.partitionBy("source").orderBy("doc_id")
    return rows.select(F.col("source").alias("book"), F.row_number().over(order).cast("long").alias("chapter_no"), *[c for c in rows.columns if c != "source"])


def front_matter_end(lines: Column) -> Column:
    """Number of lines of a front matter: a first ``---``, and within 40 lines a closing one behind a ``key:`` line; else 0."""
    head = F.slice(lines, 1, 40)
    close = F.array_position(F.transform(F.slice(head, F.lit(2), F.lit(39)), lambda x: T.jtrim(x) == "---"), True).cast("int")
    keyed = F.exists(F.slice(head, F.lit(2), F.greatest(close - 1, F.lit(0))), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    opened = T.jtrim(F.try_element_at(lines, F.lit(1))) == "---"
    return F.when(opened & (close > 0) & keyed, close + 1).otherwise(0)


def unfenced(lines: Column, strict: bool = True) -> Column:
    """True for each line outside fences; a fence's own lines are inside.

    A fence closes on a run of its own character, at least as long as the one
    that opened it unless ``strict`` is false.  The fold goes through the fence
    lines only.
    """
    mark = lambda x: F.regexp_extract(T.jtrim(x), r"^(`{3,}|~{3,})", 1)
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), mark(x).alias("mark"))), lambda z: z["mark"] != "")
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))
    part = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))

    def step(s, z):
        m = z["mark"]
        closes = (F.substring(m, 1, 1) == F.substring(s["open"], 1, 1)) & (F.length(m) >= (F.length(s["open"]) if strict else F.lit(1)))
        opened = F.struct(m.alias("open"), z["at"].alias("at"), s["out"].alias("out"))
        closed = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.concat(s["out"], part(s["at"], z["at"])).alias("out"))
        return F.when(s["open"] == "", opened).when(closes, closed).otherwise(s)

    inside = F.aggregate(marks, start, step, lambda s: F.when(s["open"] == "", s["out"]).otherwise(F.concat(s["out"], part(s["at"], F.lit(1 << 30)))))
    return T.let(inside, lambda fences: F.transform(lines, lambda x, i: ~F.exists(fences, lambda f: (i >= f["a"]) & (i <= f["b"]))))


def prose(text: str | Column, strict: bool = True) -> Column:
    """Array of (line_no from 1, trimmed line) outside front matter and fences.

    Only a text that may hold either is searched for them.
    """
    text = F.col(text) if isinstance(text, str) else text
    each = lambda own: F.transform(own, lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), T.jtrim(x).alias("line")))
    kept = lambda own: T.let(F.struct(unfenced(own, strict).alias("open"), front_matter_end(own).alias("skip")), lambda f: F.filter(each(own), lambda x: F.element_at(f["open"], x["line_no"].cast("int")) & (x["line_no"] > f["skip"])))
    special = F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~")) | text.rlike(r"\A[\s\u3000\u00a0\ufeff]*---")
    return T.let(F.split(text, r"\r?\n", -1), lambda own: F.when(special, kept(own)).otherwise(each(own)))


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, line_no (from 1), line of every line; ``keep`` names columns to carry along."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", r"\r?\n", -1)).alias("_at", "line")).select("doc_id", *keep, (F.col("_at") + 1).cast("long").alias("line_no"), "line")


def prose_lines(docs: DataFrame, *keep: str, strict: bool = True) -> DataFrame:
    """doc_id, line_no, line (trimmed), blank, structural: the lines outside front matter and fences, with their own numbers."""
    each = docs.select("doc_id", *keep, F.explode(prose("text", strict)).alias("x"))
    return each.select("doc_id", *keep, "x.line_no", "x.line").select("*", (F.col("line") == "").alias("blank"), (T.is_divider("line") | T.is_structural("line")).alias("structural"))


def narrative_lines(docs: DataFrame, pack: Pack, *keep: str) -> DataFrame:
    """Prose lines that are neither blank nor structural, with ``narrative`` (quotes removed) and ``visible`` (its length)."""
    rows = prose_lines(docs, *keep).where("not blank and not structural").drop("blank", "structural")
    return rows.withColumn("narrative", T.strip_quoted("line")).withColumn("visible", T.visible_length("narrative", pack.visible))


def narrative_texts(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, narrative, full: the lines that count, end to end, without and with quoted spans; every document with prose has a row.

    A text's lines are joined inside its row; nothing is shuffled.
    """
    counts = F.filter(prose("text"), lambda x: (x["line"] != "") & ~T.is_divider(x["line"]) & ~T.is_structural(x["line"]))
    rows = docs.select("doc_id", F.transform(counts, lambda x: x["line"]).alias("_l")).where(F.size("_l") > 0)
    return rows.select("doc_id", F.array_join(F.transform("_l", T.strip_quoted), "").alias("narrative"), F.array_join("_l", "\n").alias("full"))


def sentence_rows(docs: DataFrame, pack: Pack, *keep: str) -> DataFrame:
    """doc_id, sentence_no, sentence, visible of every sentence of the whole text."""
    rows = docs.select("doc_id", *keep, F.posexplode(T.sentences("text", pack.ends)).alias("_at", "sentence"))
    return rows.select("doc_id", *keep, (F.col("_at") + 1).cast("long").alias("sentence_no"), "sentence", T.visible_length("sentence", pack.visible).alias("visible"))


def spread(lengths: Column) -> tuple[Column, Column, Column]:
    """(n, mean, population deviation / mean) of an array of whole numbers, by exact sums; nulls where there is nothing."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    n, s = F.size(lengths).cast("double"), total(lengths).cast("double")
    q = total(F.transform(lengths, lambda x: x.cast("long") * x)).cast("double")
    mean = s / F.nullif(n, F.lit(0.0))
    return n, mean, F.sqrt(F.greatest(q / F.nullif(n, F.lit(0.0)) - mean * mean, F.lit(0.0))) / F.nullif(mean, F.lit(0.0))


def windows_ttr(tokens: Column, size: int = 500) -> Column:
    """Smallest share of distinct tokens over whole windows of ``size``, or over all where none is whole; 0 under 50 tokens."""
    n = F.size(tokens)
    share = lambda w: F.size(F.array_distinct(w)) / F.size(w)
    whole = F.transform(F.sequence(F.lit(0), F.floor(n / size) - 1), lambda i: share(F.slice(tokens, (i * size + 1).cast("int"), F.lit(size))))
    return F.when(n < 50, F.lit(0.0)).when(n < size, share(tokens)).otherwise(F.array_min(whole))


def poorest_window(text: str | Column, tokens: str = "[A-Za-z0-9]+|[一-鿿]", size: int = 500) -> Column:
    """``windows_ttr`` of a text's tokens, which stay inside one function; null of a null text."""
    pattern = re.compile(tokens)

    def share(t: str | None) -> float | None:
        if t is None:
            return None
        found = pattern.findall(t)
        n = len(found)
        if n < size:
            return len(set(found)) / n if n >= 50 else 0.0
        return min(len(set(found[i * size : (i + 1) * size])) / size for i in range(n // size))

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([share(t) for t in texts.to_pylist()], pa.float64())

    return once(of, "double")(text)
