"""Scanners and rewrites of punctuation, as regular expressions and rule tables inside Spark expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import once

#: Separators and stops of the contrast scanner, its spans, and the cues of the pause rules.
SOFT, HARD, STOP = "，,、；;：:—…-", "。！？!?.", "。！？!?\n"
GUARD, COMPACT, PARTICLES = "是莫岂别", "不就也", "吗吧嘛"
NEGATIVE_SPAN, POSITIVE_SPAN = 50, 80
OPENS = "因为|原来|这是|那是|也就是|换句话|说白了|所谓|答案|原因|结果|真相|问题在于"
CLOSES = "原因|答案|真相|结果|结论|问题|选择|意思"
PAUSE = r"…+|\.{3,}|——|—|--+"
LATIN_NOT = r"\b(not|pas|nicht|no)\b"
LATIN_CONTRAST = LATIN_NOT + r"[^.!?\n]{1,50}?\b(but|mais|sondern|sino)\b[^.!?\n]{0,80}"

#: White space inside a line.
INLINE = r"[\s&&[^\n]]"


def contrast_pattern() -> str:
    """One expression for "not A but B".

    The lift is the first of: ``而是``; a separator with ``而是`` (soft ones only) or
    ``是`` behind it; or, with no separator in between, a ``是`` of its own.  Each
    kind of character has one place in the expression, so there is nothing to try
    in two ways.
    """
    gap = r"[ \t\r]*+(?:\n[ \t\r]*+)?+"
    lifts = f"是(?![{PARTICLES}])"
    plain = f"(?!而是)[^{SOFT}{HARD}\n]"
    bare = f"(?:(?!而是)[^是{SOFT}{HARD}\n]|(?<=[{COMPACT}])是)"
    own = f"(?<![{COMPACT}])是"
    passed = f"[{SOFT}](?!{gap}(?:而是|{lifts}))|\\.(?!{gap}{lifts})"
    parted = f"(?:而是|[{SOFT}]{gap}(?:而是|{lifts})|[{HARD}]{gap}{lifts})"
    lift = f"{bare}{{0,{NEGATIVE_SPAN}}}{own}|(?!{bare}*+{own})(?:{plain}|{passed}){{0,{NEGATIVE_SPAN}}}{parted}"
    return f"(?<![{GUARD}])不是(?:{lift})[^{STOP}]{{0,{POSITIVE_SPAN}}}"


CONTRAST = contrast_pattern()


def in_dialogue(before: Column) -> Column:
    """Whether what stands before a place leaves a quotation open."""
    n = lambda chars: F.length(before) - F.length(F.translate(before, chars, ""))
    return (n("“‘「『") > n("”’」』")) | (n('"') % 2 == 1)


def contrast_findings(docs: DataFrame, pattern: str = CONTRAST, least: int = 4) -> DataFrame:
    """doc_id, line_no, severity, passage of each contrast, left to right without overlap; inside dialogue advisory, else blocking."""
    pieces, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = docs.where(F.col("text").rlike(pattern)).select("doc_id", "text", T.spans(pieces, found).alias("_s"))
    each = rows.select("doc_id", "text", F.explode("_s").alias("x")).select("doc_id", F.regexp_replace("x.found", r"[\s|）)】\]]+\z", "").alias("passage"), F.substring("text", F.lit(1), F.col("x.pos") - 1).alias("_b"))
    line = (F.lit(1) + F.length("_b") - F.length(F.translate("_b", "\n", ""))).cast("long")
    severity = F.when(in_dialogue(F.col("_b")), "advisory").otherwise("blocking")
    return each.where(F.length("passage") >= least).select("doc_id", line.alias("line_no"), severity.alias("severity"), "passage")


#: What stands for a pause, by the characters before and behind it on its line (a NUL between them); the first rule that fits decides.
PAUSE_RULES = (
    (r"^\x00|[「『（(\"']\x00", ""),
    (r"[0-9]\x00[0-9]", "到"),
    (r"[，,。.!！?？;；:：…]\x00", ""),
    (r"\x00(?:\z|[\"“”」』])", "。"),
    (r"\x00[，,。.!！?？;；:：、…‘’'）)]", ""),
    (rf"\x00(?:{OPENS})|(?:{CLOSES})\x00", "："),
    ("", "，"),
)


def rewrite_pauses(text: Column) -> Column:
    """(text, n): the text with its pause tokens replaced, and how many there were."""

    def own(x: Column) -> Column:
        pieces, tokens = x["pieces"], x["tokens"]

        def mark(i: Column) -> Column:
            token = lambda k: F.coalesce(F.get(tokens, k), F.lit(""))
            left = F.regexp_extract(F.concat(token(i - 1), F.get(pieces, i)), rf"((?:[^\n]?\S)?){INLINE}*\z", 1)
            right = F.regexp_extract(F.concat(F.get(pieces, i + 1), token(i + 1)), rf"^{INLINE}*([^\n]{{0,4}})", 1)
            sides, out = F.concat(left, F.lit("\0"), right), F.lit("")
            for pattern, to in reversed(PAUSE_RULES):
                out = F.when(sides.rlike(pattern), F.lit(to)).otherwise(out)
            return F.concat(out, F.get(pieces, i + 1))

        rest = F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), mark)
        return F.struct(F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, "")).alias("text"), F.size(tokens).cast("long").alias("n"))

    cut = F.struct(F.split(text, PAUSE, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(PAUSE), F.lit(0)).alias("tokens"))
    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.when(text.rlike(PAUSE), T.let(cut, own)).otherwise(same)


def corner_quotes(text: Column) -> Column:
    """Straight and curly double quotes as corner quotes.

    A straight one opens outside of quotes, and behind a mark; a new line starts
    inside at most one quote.  The fold sees the quotes and the line breaks only.
    """
    marks = r"[\"“”\n]"

    def own(x: Column) -> Column:
        def step(s: Column, z: Column) -> Column:
            behind = F.regexp_extract(z["piece"], rf"(\S?){INLINE}*\z", 1)
            opens = (z["mark"] == "“") | ((z["mark"] == '"') & ((s["depth"] == 0) | behind.rlike(r"^[，,。.!！?？;；:：、…\"“”」』）)「『（(']?\z")))
            depth = F.when(z["mark"] == "\n", F.least(s["depth"], F.lit(1))).when(opens, s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
            to = F.when(z["mark"] == "\n", F.lit("\n")).when(opens, F.lit("「")).otherwise(F.lit("」"))
            return F.struct(depth.alias("depth"), F.concat(s["out"], z["piece"], to).alias("out"))

        start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
        pairs = F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["marks"])), x["marks"], lambda p, m: F.struct(p.alias("piece"), m.alias("mark")))
        return F.concat(F.aggregate(pairs, start, step, lambda s: s["out"]), F.element_at(x["pieces"], -1))

    cut = F.struct(F.split(text, marks, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(marks), F.lit(0)).alias("marks"))
    return T.let(cut, own)


#: A front matter of at most 40 lines, a fence line, and a divider line.
FRONT = rf"(?d)\A{INLINE}*---{INLINE}*\n(?:(?!{INLINE}*---{INLINE}*(?:\n|\z))[^\n]*\n){{0,38}}{INLINE}*---{INLINE}*(?:\n|\z)"
KEY = r"(?md)^[A-Za-z_][\w-]*\s*:"
FENCE = rf"(?md)^{INLINE}*```[^\n]*(?:\n|\z)"
RULE = rf"(?md)^{INLINE}*---{INLINE}*\n|(?d)(?:\A|\n){INLINE}*---{INLINE}*\z"


def normalize(text: Column, quotes: str = "keep") -> Column:
    """(text, n): pauses rewritten, divider lines dropped, quotes in one style, and the number of changes.

    Fences and a front matter stay as they are.  Where a text has CRLF, all its
    line ends become CRLF.
    """
    styled = {"keep": lambda t: t, "ascii": as_ascii_quotes, "corner": corner_quotes}[quotes]
    touched = {"keep": lambda t: F.lit(0), "ascii": lambda t: T.count_matches(t, "[「」『』“”]"), "corner": lambda t: T.count_matches(t, '["“”]')}[quotes]

    def block(t: Column) -> Column:
        whole = lambda b: F.struct(styled(b["p"]["text"]).alias("text"), (b["p"]["n"] + b["rules"] + touched(b["p"]["text"])).cast("long").alias("n"))
        return T.let(F.struct(rewrite_pauses(F.regexp_replace(t, RULE, "")).alias("p"), T.count_matches(t, RULE).alias("rules")), whole)

    def body(t: Column) -> Column:
        def joined(x: Column) -> Column:
            done = F.transform(x["blocks"], lambda b, i: F.when(i % 2 == 0, block(b)).otherwise(F.struct(b.alias("text"), F.lit(0).cast("long").alias("n"))))
            ends = F.concat(x["fences"], F.array(F.lit("")))
            sides = lambda d: F.struct(F.array_join(F.zip_with(d, ends, lambda b, f: F.concat(b["text"], f)), "").alias("text"), F.aggregate(d, F.lit(0).cast("long"), lambda s, b: s + b["n"]).alias("n"))
            return T.let(done, sides)

        return T.let(F.struct(F.split(t, FENCE, -1).alias("blocks"), F.regexp_extract_all(t, F.lit(FENCE), F.lit(0)).alias("fences")), joined)

    def parts(x: Column) -> Column:
        head = T.let(F.regexp_extract(x, FRONT, 0), lambda h: F.when(h.rlike(KEY), h).otherwise(F.lit("")))
        return T.let(head, lambda h: T.let(body(F.substring(x, F.length(h) + 1, F.length(x))), lambda b: F.struct(F.concat(h, b["text"]).alias("text"), b["n"].alias("n"))))

    crlf = F.contains(text, F.lit("\r\n"))
    out = T.let(F.replace(text, F.lit("\r\n"), F.lit("\n")), parts)
    return T.let(out, lambda o: F.struct(F.when(crlf, F.replace(o["text"], F.lit("\n"), F.lit("\r\n"))).otherwise(o["text"]).alias("text"), F.coalesce(o["n"], F.lit(0).cast("long")).alias("n")))


def normalized(docs: DataFrame, quotes: str = "keep") -> DataFrame:
    """doc_id, text_normalized, changes of every document; a null text stays null, with no change."""
    return docs.select("doc_id", normalize(F.col("text"), quotes).alias("x")).select("doc_id", F.col("x.text").alias("text_normalized"), F.col("x.n").alias("changes"))


def as_ascii_quotes(c: str | Column) -> Column:
    return F.translate(F.col(c) if isinstance(c, str) else c, "「」『』“”", '""""""')


def dictionary_pattern(words: list[str], longest: int = 4) -> str:
    """Alternation of forward maximum matching: runs of Latin letters and digits, then words, the longest first, then single characters."""
    terms = sorted({w for w in words if 2 <= len(w) <= longest}, key=lambda w: (-len(w), w))
    return "|".join(["[A-Za-z0-9]+", *map(re.escape, terms), "[一-鿿]"])


def dictionary_tokens(docs: DataFrame, words: list[str], longest: int = 4) -> DataFrame:
    """doc_id, tokens: forward maximum matching with a dictionary, which is a parameter; what is in no token is skipped."""
    pattern = re.compile(dictionary_pattern(words, longest))

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([pattern.findall(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return docs.select("doc_id", once(cut, "array<string>")("text").alias("tokens"))
