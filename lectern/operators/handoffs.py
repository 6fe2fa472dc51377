"""Packets that hand a chapter over to the next: their sections, and old packets compacted into a summary.

Each packet is cut inside its row; what a summary keeps are groupings by (book,
item), so a book of any length and a book with a third of all packets spread
over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Section titles, marks of lines, and the words of a planted thread that is resolved.
TITLES = {
    "prev_recap": "前章回顾", "character_states": "角色当前状态", "must_continue": "必须延续的细节", "forbidden": "禁止矛盾", "state_lock": "状态锁定", "value_lock": "数值锁定",
    "knowledge_boundary": "角色知识边界", "flashback": "闪回标注", "new_state": "本章新增状态", "foreshadow": "伏笔", "quality_budget": "质感预算", "dedup_list": "跨章去重",
}
RESOLVED = ("已回收", "已揭晓", "已解决")
FIELDS = ("location", "body", "mind", "items", "power", "alive")
PACKET = (r"(?s)【衔接包】.*?(?=\n#{1,3}\s|【|\z)", r"(?s)\[衔接包[^\]]*\].*?(?=\n#{1,3}\s|\[章节|\z)")
#: Lines of a section that count: which, and what is taken off them.
KEPT = {"foreshadow": ("[├└\\-•]", "[├└│]"), "forbidden": ("❌|不能", "[├└│❌]"), "state_lock": ("→|不能", "[├└│]"), "value_lock": ("[=：]", "[├└│]")}


def packet(text: str | Column) -> Column:
    """The packet inside of a text; a text without its mark is one as a whole."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in PACKET]
    return F.coalesce(*found, text)


def section(packed: Column, title: str) -> Column:
    """A section with its title, by the first of three forms of titles that is there; null without one."""
    forms = (rf"(?s)\[{title}\].*?(?=\n\[|\z)", rf"(?s)【{title}】.*?(?=\n【|\z)", rf"(?s)(?:^|\n)#{{1,3}}\s*{title}.*?(?=\n#{{1,3}}\s|\z)")
    return F.nullif(T.jtrim(F.coalesce(*[F.nullif(F.regexp_extract(packed, p, 0), F.lit("")) for p in forms])), F.lit(""))


def packets(chapters: DataFrame) -> DataFrame:
    """book, chapter, raw_length and a column for each section of ``chapters(book, chapter, text)``."""
    rows = chapters.select("book", "chapter", packet("text").alias("_p"))
    return rows.select("book", "chapter", F.length("_p").cast("long").alias("raw_length"), *[section(F.col("_p"), t).alias(k) for k, t in TITLES.items()])


def to_compact(parsed: DataFrame, threshold: int = 10, keep: int = 3) -> DataFrame:
    """``parsed`` packets of books with more than ``threshold`` chapters, without their last ``keep`` chapters.

    Packets that repeat a chapter stay together; those without a book or a
    chapter take no part.  Only the last chapters of a book go through a window,
    which tasks cut to ``keep`` before the shuffle.
    """
    places = parsed.select("book", "chapter").where("chapter is not null").distinct()
    late = Window.partitionBy("book").orderBy(F.desc("chapter"))
    ends = places.withColumn("_r", F.row_number().over(late)).where(F.col("_r") <= keep).groupBy("book").agg(F.min("chapter").alias("_from"))
    long = places.groupBy("book").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > threshold)
    return parsed.join(long.join(ends, "book").select("book", "_from"), "book").where("chapter < _from").drop("_from")


def _lines(own: Column, kind: str) -> Column:
    mark, off = KEPT[kind]
    kept = F.filter(F.split(own, "\n", -1), lambda x: x.rlike(mark) & (T.jtrim(x) != ""))
    return F.filter(F.transform(kept, lambda x: T.jtrim(F.regexp_replace(x, off, ""))), lambda x: x != "")


def kept_items(old: DataFrame) -> DataFrame:
    """book, kind, item, chapter, line: what packets to compact say, each item where it is first said.

    kind is active or resolved (planted threads), forbidden, state_lock or
    value_lock.  An item that is active once and resolved later is in both, as
    its line differs.
    """

    def of(k: str) -> Column:
        own = F.transform(_lines(F.col(k), k), lambda x, i: F.struct(F.lit(k).alias("kind"), x.alias("item"), i.cast("long").alias("line")))
        return F.coalesce(own, F.array().cast("array<struct<kind:string,item:string,line:bigint>>"))

    every = F.concat(*map(of, KEPT))
    rows = old.select("book", "chapter", F.explode(every).alias("x")).select("book", "chapter", "x.*")
    resolved = F.col("item").rlike("|".join(RESOLVED))
    kind = F.when(F.col("kind") != "foreshadow", F.col("kind")).when(resolved, "resolved").otherwise("active")
    first = rows.withColumn("kind", kind).groupBy("book", "kind", "item").agg(F.min(F.struct("chapter", "line")).alias("at"))
    return first.select("book", "kind", "item", "at.chapter", "at.line")


def last_states(old: DataFrame) -> DataFrame:
    """book, name, the six fields and chapter: the last row of each character in the tables of packets to compact."""
    wanted = F.filter(F.split("character_states", "\n", -1), lambda x: F.contains(x, F.lit("|")) & ~F.contains(x, F.lit("---")) & ~F.contains(x, F.lit("角色")))
    cells = F.transform(wanted, lambda x: F.filter(F.transform(F.split(x, r"\|", -1), T.jtrim), lambda c: c != ""))
    rows = old.select("book", "chapter", F.posexplode(cells).alias("_i", "_c")).where(F.size("_c") >= 2)
    rest = F.struct("chapter", "_i", *[F.coalesce(F.get("_c", F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(FIELDS, 1)])
    last = rows.groupBy("book", F.get("_c", F.lit(0)).alias("name")).agg(F.max(rest).alias("x"))
    return last.select("book", "name", *[F.col(f"x.{f}") for f in FIELDS], "x.chapter")


def summaries(old: DataFrame) -> DataFrame:
    """book, first, last (chapters compacted), packets, raw_length, characters, and the counts of each kind of ``kept_items``."""
    spans = old.groupBy("book").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"), F.count(F.lit(1)).alias("packets"), F.sum("raw_length").alias("raw_length"))
    kinds = ("active", "resolved", "forbidden", "state_lock", "value_lock")
    items = kept_items(old).groupBy("book").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.sum(F.length("item")).alias("_chars"))
    people = last_states(old).groupBy("book").agg(F.count(F.lit(1)).alias("characters"), F.sum(sum((F.length(f) for f in FIELDS), F.length("name"))).alias("_own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    size = zero("_chars") + zero("_own")
    ratio = F.floor(size * 100.0 / F.greatest(F.col("raw_length"), F.lit(1)) + 0.5).cast("long").alias("percent_kept")
    return spans.join(items, "book", "left").join(people, "book", "left").select("book", "first", "last", "packets", "raw_length", *[zero(k).alias(k) for k in (*kinds, "characters")], ratio)


def start_chapter(line: str | Column) -> Column:
    """Chapter in which a line says that a thread starts: behind a word of planting, else the first one named; null without one."""
    line = F.col(line) if isinstance(line, str) else line
    found = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in ("(?:起始|埋设|埋下|埋下伏笔|开始).*?第([0-9]+)章", "第([0-9]+)章")]
    return F.coalesce(*found).try_cast("long")


def overdue_lines(trackers: DataFrame, now: DataFrame, limit: int = 50) -> DataFrame:
    """book, line_no, start, age of lines of ``trackers(book, text)`` tagged ACTIVE whose thread started more than ``limit`` chapters before the newest of ``now(book, chapter)``."""
    lines = trackers.select("book", F.posexplode(F.split("text", r"\r?\n", -1)).alias("_i", "line")).where(F.contains("line", F.lit("ACTIVE")))
    rows = lines.select("book", (F.col("_i") + 1).cast("long").alias("line_no"), start_chapter("line").alias("start")).where("start > 0")
    newest = now.groupBy("book").agg(F.max("chapter").alias("_at")).where("_at > 0")
    return rows.join(newest, "book").withColumn("age", (F.col("_at") - F.col("start")).cast("long")).where(F.col("age") > limit).drop("_at")


#: Patterns of a version, in their order.
VERSIONS = (r"(?i)Version:\s*(V[\d.]+)", r"(?i)版本[：:]\s*(V[\d.]+)", r"(?i)#\s*S.*?V([\d.]+)", r"\bV(\d+\.\d+(?:\.\d+)?)\b")


def header_version(text: str | Column, head: int = 30) -> Column:
    """The version that the first lines of a text name, as V and numbers; null without one."""
    text = F.col(text) if isinstance(text, str) else text
    top = F.substring_index(text, "\n", head)
    found = F.coalesce(*[F.nullif(F.regexp_extract(top, p, 1), F.lit("")) for p in VERSIONS])
    return F.upper(F.when(found.rlike("^[Vv]"), found).otherwise(F.concat(F.lit("V"), found)))


#: Signs and words of a tracked thread's state, in their order.
SIGNS = {"green": "🟢", "yellow": "🟡", "red": "🔴", "black": "⚫"}
WORDS = {"black": "(?i)已回收|已解决|已揭晓|resolved", "green": "(?i)活跃|未回收|待回收|active", "yellow": "(?i)风险|警告|warning", "red": "(?i)过期|失效|critical"}


def tracked_threads(trackers: DataFrame) -> DataFrame:
    """book, line_no, status, text (at most 80 characters, may be empty) of the lines of ``trackers(book, text)`` that show a state, by a sign or else by a word."""
    lines = trackers.select("book", F.posexplode(F.split("text", r"\r?\n", -1)).alias("_i", "_l")).select("book", (F.col("_i") + 1).cast("long").alias("line_no"), T.jtrim("_l").alias("_l"))
    status = F.coalesce(*[F.when(F.contains("_l", F.lit(sign)), s) for s, sign in SIGNS.items()], *[F.when(F.col("_l").rlike(p), s) for s, p in WORDS.items()])
    rows = lines.where("_l <> ''").where(~F.startswith("_l", F.lit("#")) & ~(F.startswith("_l", F.lit("|")) & F.contains("_l", F.lit("---"))))
    bare = F.regexp_replace(F.regexp_replace("_l", "[🟢🟡🔴⚫️]", ""), r"^\s*[├└│\-•*]+\s*", "")
    return rows.select("book", "line_no", status.alias("status"), F.substring(T.jtrim(bare), 1, 80).alias("text")).where("status is not null")


def thread_board(threads: DataFrame) -> DataFrame:
    """book and the number of ``tracked_threads`` in each state."""
    return threads.groupBy("book").agg(*[F.count_if(F.col("status") == s).alias(s) for s in SIGNS])


def recent_rates(chapters: DataFrame, rates: DataFrame, last: int = 10) -> DataFrame:
    """book, doc_id, rate of the last chapters of each book: ``chapters(book, doc_id)`` in order of doc_id, and ``rates(doc_id, rate)``.

    Tasks cut a book to ``last`` chapters before the shuffle.
    """
    late = Window.partitionBy("book").orderBy(F.desc("doc_id"))
    ends = chapters.select("book", "doc_id").withColumn("_r", F.row_number().over(late)).where(F.col("_r") <= last).drop("_r")
    return ends.join(rates.select("doc_id", "rate"), "doc_id").select("book", "doc_id", "rate")


def in_reading_order(files: DataFrame) -> DataFrame:
    """``files(file, lines)``, those that exist first and the longest of them first; a missing file has -1 lines or null, ties go by name."""
    have = F.coalesce(F.col("lines"), F.lit(-1)) >= 0
    return files.orderBy(F.when(have, 0).otherwise(1), F.when(have, -F.col("lines")), "file")
