"""Column functions over texts.  All are Spark expressions, so they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as blank at the ends of a text; Chinese paragraphs start with U+3000.
BLANK = r"[\s　 ﻿]+"
BLANKS = " \t\n\x0b\f\r　 ﻿"  # the same, as characters
#: A pattern of one character: a class, or one of several.
ONE = re.compile(r"\[[^\[\]]+\](\|\[[^\[\]]+\])*")
#: Quoted spans, in the order in which they are removed.
QUOTES = ("「[^」]*」", "『[^』]*』", "【[^】]*】", '"[^"]*"', "'[^']*'", "“[^”]*”", "‘[^’]*’")
DIVIDER = r"^(-{3,}|[*_]{3,})\z"
STRUCTURAL = r"^(#{1,6}\s|>|[-*+]\s|\d+[.)]\s|\|)"
#: Numerals and their worth.
DIGITS = {"一": 1.0, "二": 2.0, "两": 2.0, "三": 3.0, "四": 4.0, "五": 5.0, "六": 6.0, "七": 7.0, "八": 8.0, "九": 9.0, "零": 0.0, "半": 0.5}
TENS = {"十": 10.0, "百": 100.0, "千": 1000.0}
SECTIONS = {"万": 1e4, "亿": 1e8}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(pieces: Column, found: Column) -> Column:
    """Array of (found, pos from 1) of matches, from what a text's split and its extraction by one pattern give.

    Lengths are added once, from the left.
    """
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<found:string,pos:int>>").alias("out"))

    def step(s: Column, z: Column) -> Column:
        at = s["at"] + F.length(z["before"])
        return F.struct((at + F.length(z["found"])).alias("at"), F.concat(s["out"], F.array(F.struct(z["found"].alias("found"), at.alias("pos")))).alias("out"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, f: F.struct(p.alias("before"), f.alias("found")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def jtrim(c: str | Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.btrim(_col(c), F.lit(BLANKS))


def count_matches(c: str | Column, pattern: str) -> Column:
    """Matches of a pattern; characters of a class are counted by what a text lacks without their runs, so that no match is kept."""
    if ONE.fullmatch(pattern):
        runs = f"[{pattern.replace(']|[', '][')}]+"
        return let(_col(c), lambda s: F.coalesce(F.length(s) - F.length(F.regexp_replace(s, runs, "")), F.lit(0)).cast("long"))
    return F.coalesce(F.regexp_count(_col(c), F.lit(pattern)), F.lit(0)).cast("long")


def count_literal(c: str | Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal; texts without it are not copied."""
    c = F.coalesce(_col(c), F.lit(""))
    n = ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("long")
    return F.when(F.contains(c, F.lit(term)), n).otherwise(F.lit(0).cast("long"))


def count_terms(c: str | Column, terms) -> Column:
    """Occurrences of all terms, each counted on its own, so overlapping terms count twice."""
    out = F.lit(0).cast("long")
    for t in terms:
        out = out + count_literal(c, t)
    return out


def contains_any(c: str | Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(_col(c), F.lit(t))
    return out


def visible_length(c: str | Column, visible: str) -> Column:
    return count_matches(c, visible)


def is_divider(c: str | Column) -> Column:
    return _col(c).rlike(DIVIDER)


def is_structural(c: str | Column) -> Column:
    return _col(c).rlike(STRUCTURAL)


def strip_quoted(c: str | Column) -> Column:
    """Without quoted spans; a line without an opening mark is not searched for each kind."""
    whole = out = _col(c)
    for q in QUOTES:
        out = F.regexp_replace(out, q, "")
    return F.when(whole.rlike("[「『【\"'“‘]"), out).otherwise(whole)


def sentences(c: str | Column, ends: str) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(_col(c), ends, -1), jtrim), lambda s: s != "")


def kept_sentences(c: str | Column) -> Column:
    """Sentences with the mark that ends them."""
    pieces = F.regexp_extract_all(_col(c), F.lit(r"[^。！？!?\n]*[。！？!?\n]|[^。！？!?\n]+\z"), F.lit(0))
    return F.filter(F.transform(pieces, jtrim), lambda s: s != "")


def plain_sentences(c: str | Column) -> Column:
    """Sentences for finding repeats: neither an ellipsis nor a line break ends one."""
    return F.filter(F.transform(F.split(_col(c), "[。！？!?]", -1), jtrim), lambda s: s != "")


def without_markdown(c: str | Column) -> Column:
    """A text without fenced blocks, heading marks and bold marks."""
    c = F.regexp_replace(_col(c), r"(?s)```.*?```", "")
    return F.replace(F.regexp_replace(c, r"(?m)^#{1,6}\s+", ""), F.lit("**"), F.lit(""))


def said(c: str | Column) -> Column:
    """What quotations of all families of double quotes hold, in order, without empty ones."""
    found = F.regexp_extract_all(_col(c), F.lit("[“\"][^”\"]*[”\"]|[「『][^」』]*[」』]"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), lambda x: x != "")


def numeral_prefix(c: str | Column) -> Column:
    """``numeral`` of what stands before the first character that belongs to none."""
    return numeral(F.regexp_extract(_col(c), "^[零一二两三四五六七八九半十百千万亿]*", 0))


def compact(c: str | Column) -> Column:
    """One line of at most 80 characters."""
    one = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    return F.when(F.length(one) > 80, F.concat(F.substring(one, 1, 77), F.lit("..."))).otherwise(one)


def snippet(c: str | Column, pos: Column, around: int) -> Column:
    """The text ``around`` characters before and behind a 1-based position."""
    start = F.greatest(pos - around, F.lit(1))
    return F.substring(_col(c), start, pos + around - start)


def line_of(c: str | Column, pos: Column) -> Column:
    """1-based line of a 1-based position."""
    return (F.lit(1) + F.regexp_count(F.substring(_col(c), F.lit(1), pos - 1), F.lit("\n"))).cast("long")


def char_ngrams(c: str | Column, n: int) -> Column:
    """Every run of n characters, in order.  The characters are cut once and bound to a name, as a substring of each place would walk the text again."""

    def own(chars: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))
        return F.when(F.size(chars) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(F.split(_col(c), "")), own), 1)


def thirds(c: str | Column) -> Column:
    """Three slices of a text; the last takes the rest."""
    c = _col(c)
    n = F.floor(F.length(c) / 3).cast("int")
    return F.array(F.substring(c, F.lit(1), n), F.substring(c, n + 1, n), F.substring(c, 2 * n + 1, F.length(c)))


def segments(c: str | Column, n: int) -> Column:
    """Whole slices of n characters; a shorter rest is left out."""
    c = _col(c)
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(0), F.floor(F.length(c) / n) - 1), lambda i: F.substring(c, (i * n + 1).cast("int"), F.lit(n)))).otherwise(F.array().cast("array<string>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def scaled(c: Column, by: float = 1e6) -> Column:
    """A ratio as a whole number, halves up."""
    return F.floor(c * by + 0.5).cast("long")


def numeral(c: str | Column) -> Column:
    """Worth of a Chinese or Arabic numeral; other characters are skipped.

    Tens build up a section, and a section mark multiplies all that stands
    before it.
    """
    c = _col(c)
    worth = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    digits, tens, parts = worth(DIGITS), worth(TENS), worth(SECTIONS)
    none = F.lit(0.0)
    start = F.struct(none.alias("total"), none.alias("part"), none.alias("digit"))

    def step(s, ch):
        d, t, p = F.try_element_at(digits, ch), F.try_element_at(tens, ch), F.try_element_at(parts, ch)
        unit = F.when(s["digit"] == 0, 1.0).otherwise(s["digit"])
        return (
            F.when(d.isNotNull(), F.struct(s["total"].alias("total"), s["part"].alias("part"), d.alias("digit")))
            .when(t.isNotNull(), F.struct(s["total"].alias("total"), (s["part"] + unit * t).alias("part"), none.alias("digit")))
            .when(p.isNotNull(), F.struct(((s["total"] + s["part"] + s["digit"]) * p).alias("total"), none.alias("part"), none.alias("digit")))
            .otherwise(s)
        )

    folded = F.aggregate(F.split(c, ""), start, step, lambda s: s["total"] + s["part"] + s["digit"])
    return F.when(c.rlike(r"^\d+(\.\d+)?\z"), c.try_cast("double")).otherwise(folded)


def chapter_number(name: str | Column) -> Column:
    """First whole number in a file name."""
    return F.regexp_extract(_col(name), r"(\d+)", 1).try_cast("long")
