"""Numbers in texts against the anchors of a project: kinds of several patterns, names, routes, and fights beyond a tier.

A kind has patterns in order; of several that match at one place the first counts.
Anchors are met by equality joins on the names, and on the places of routes, that
the context of a number holds, so no pair of a number and an anchor is made without
a word in common.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import Lexicon


@dataclass(frozen=True)
class Kinds:
    """Patterns as (expression, group of the value or 0, group of the direction or 0), units with their other names, and what marks a fight."""

    patterns: dict = field(default_factory=dict)
    units: dict = field(default_factory=dict)
    directions: str = ""
    tiers: tuple = ()
    solo: tuple = ()
    kill: tuple = ()
    battle: str = ""
    daily: str = ""
    between: str = r"[-—–~至到→\s,，、]+"  # the places of a route's name


NUM = "[一二两三四五六七八九十百]+"
#: The patterns of numbers, units with their other names, and the marks of fights and of daily life.
ZH = Kinds(
    patterns={
        "age": ((r"(\d+)岁", 1, 0), (rf"({NUM})岁", 1, 0), (r"快(\d+)了", 1, 0), (r"年近(\d+)", 1, 0), (r"年过(\d+)", 1, 0), ("(十[一二三四五六七八九]|二十[一二三四五六七八九]|[一二两三四五六七八九十]+)岁", 1, 0)),
        "distance": (
            (r"([东南西北])(\d+)(公里|千米|里|米|步|丈)", 2, 1), (r"(约|差不多|大概|近|不到)(\d+)(公里|千米|里|米|步|丈)", 2, 0), (rf"({NUM})(公里|千米|里|米|步|丈)(?:路|地|程)?", 1, 0), ("半日(?:路|程)", 0, 0), ("(一天|半天|两小时)(?:路|程|车程)", 0, 0),
        ),
        "cultivation": ((r"(\d+)枚", 1, 0), (rf"({NUM})枚", 1, 0)),
        "count": tuple((p + unit, 1, 0) for unit in "枚个名条" for p in (r"(\d+)", f"({NUM})")),
    },
    units={"公里": ("公里", "千米", "km"), "里": ("里",), "米": ("米",), "步": ("步",), "丈": ("丈",)},
    directions="东南西北",
    solo=("独自", "单挑", "一人", "凭一己之力"),
    kill=("斩杀", "击杀", "秒杀", "碾压"),
    battle="战|斗|打|杀|攻|防|敌|怪|兽|妖|魔",
    daily="路上|走路|吃饭|睡觉|看书|发呆|散步|逛街|喝茶|聊天|休息|洗澡|穿衣|照镜子",
)
#: Our own for Latin-script corpora.
LATIN = Kinds(
    patterns={
        "age": ((r"(\d+) of[ ,.]", 1, 0), (r"(\d+) (?:to|de|du|und)[ ,.]", 1, 0), (r"(\d\d) ", 1, 0)),
        "distance": ((r"([VC])[A-Za-z -]* (\d+)\.", 2, 1), (r"(\d+)(?:\.|-)", 1, 0), (r" (\d+) \(", 1, 0), (r"!! ", 0, 0)),
        "cultivation": ((r"(\d+) [a-e]", 1, 0), (r"(\d+) [a-s]", 1, 0)),
        "count": ((r"(\d+) \p{L}", 1, 0), (r"(\d+)!", 1, 0)),
    },
    units={".": (".",), "-": ("-",)},
    directions="VC",
    tiers=("token", "License"),
    solo=("and", "con", "="),
    kill=("the", "License", "token"),
    battle="a|e",
    daily="0|dans",
    between=r"[-\s]+",
)


def unit_of(raw: str | Column, kinds: Kinds) -> Column:
    """The unit whose name, or another name of it, a string holds; units with longer names first."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    out = F.lit(None).cast("string")
    for unit, names in reversed(sorted(kinds.units.items(), key=lambda u: -len(u[0]))):
        out = F.when(T.contains_any(raw, names), F.lit(unit)).otherwise(out)
    return out


def numbers(docs: DataFrame, kinds: Kinds, *only: str) -> DataFrame:
    """doc_id, kind, pos (from 1), raw, value, unit, direction, context (50 characters on both sides), before (what of it stands before raw's first place there).

    Tiers are names, found from the left, and have no value; so have distances that
    tell a time.  All is found inside a row; texts are read once.  ``only`` names
    the kinds to look for; without any all are.  A text is cut at the matches of
    those patterns only that it has some of.
    """
    parts = []
    for kind, patterns in [*kinds.patterns.items(), *([("tier", ((T_or(kinds.tiers), 0, 0),))] if kinds.tiers else [])]:
        for i, (p, value, direction) in enumerate(patterns if not only or kind in only else ()):
            parts.append(T.let(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _mentions(kind, i, p, value, direction)))
    shape = "array<struct<kind:string,pos:int,i:int,raw:string,number:string,direction:string>>"
    every = F.array_sort(F.flatten(F.array(*[F.coalesce(x, F.array().cast(shape)) for x in parts])))
    first = T.let(every, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["kind"] != x["kind"]) | (F.get(a, i - 1)["pos"] != x["pos"])))
    rows = docs.select("doc_id", "text", F.explode(first).alias("x")).select("doc_id", "text", "x.kind", "x.pos", "x.raw", "x.number", "x.direction")
    start = F.greatest(F.col("pos") - 50, F.lit(1))
    context = F.substring("text", start, F.col("pos") + F.length("raw") + 50 - start)
    rows = rows.select("doc_id", "kind", F.col("pos").cast("long").alias("pos"), "raw", F.when(F.col("number") != "", T.numeral("number")).alias("value"), F.when(F.col("kind") == "distance", unit_of("raw", kinds)).alias("unit"), F.nullif("direction", F.lit("")).alias("direction"), context.alias("context"))
    return rows.withColumn("before", F.substring("context", F.lit(1), F.instr("context", F.col("raw")) - 1))


def T_or(terms) -> str:
    """An expression for names as they are, in their own order."""
    return "|".join(r"\Q" + t + r"\E" for t in terms)


def _mentions(kind: str, i: int, p: str, value: int, direction: int):
    return lambda found: F.when(F.size(found) > 0, F.transform(T.spans(F.split("text", p, -1), found), _mention(kind, i, p, value, direction)))


def _mention(kind: str, i: int, p: str, value: int, direction: int):
    of = lambda x, g: F.regexp_extract(x["found"], p, g) if g else F.lit("")
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["pos"].alias("pos"), F.lit(i).alias("i"), x["found"].alias("raw"), of(x, value).alias("number"), of(x, direction).alias("direction"))


def _pieces(context: str, lengths: list[int]) -> Column:
    """Array of (at, piece) of all pieces of a context with the given lengths."""
    ends = F.greatest(F.length(context), F.lit(1))
    cuts = [F.transform(F.sequence(F.lit(1), ends), _piece(context, n)) for n in lengths]
    return F.filter(F.flatten(F.array(*cuts)), lambda x: x["piece"] != "")


def _piece(context: str, n: int):
    return lambda i: F.struct(i.alias("at"), F.substring(F.col(context), i, F.lit(n)).alias("piece"))


def _lengths(names: DataFrame, c: str) -> list[int]:
    return [r[0] for r in names.select(F.length(c).alias("n")).where("n > 0").distinct().orderBy("n").collect()]  # a few numbers


def anchored(found: DataFrame, people: DataFrame, kind: str, anchor: str) -> DataFrame:
    """doc_id, pos, name, value, expected: numbers of a kind that differ from the anchor of a person named before them.

    ``people(name, main, <anchor>)`` has a row for each name and alias of ``main``.
    A name that begins a longer known name at its place is not that person's; a
    person counts once a number, whatever names are there.  An anchor of null or
    0 is none.
    """
    rows = found.where(F.col("kind") == kind).where("value is not null").select("doc_id", "pos", "value", "before")
    sizes = _lengths(people, "name")
    if not sizes:
        return rows.join(people, F.lit(False)).select("doc_id", "pos", "name", "value", F.col(anchor).cast("double").alias("expected"))
    cut = rows.select("doc_id", "pos", "value", F.explode(_pieces("before", sizes)).alias("x")).select("doc_id", "pos", "value", "x.at", F.col("x.piece").alias("name"))
    met = cut.join(people.select("name", "main", F.col(anchor).cast("double").alias("expected")), "name")
    longest = met.groupBy("doc_id", "pos", "value", "at").agg(F.max_by(F.struct("main", "expected"), F.length("name")).alias("p"))
    one = longest.select("doc_id", "pos", "value", "p.*").where("expected > 0 and value <> expected").distinct()
    return one.select("doc_id", "pos", F.col("main").alias("name"), "value", "expected")


def routes_of(anchors: DataFrame, kinds: Kinds) -> DataFrame:
    """route, expected, unit, direction, places of ``anchors(route, distance)``: the first number of a distance as it is written, and the places that the route's name is made of."""
    number = F.regexp_extract("distance", rf"(?:\d|{NUM[:-1]})+", 0)
    places = F.filter(F.transform(F.split("route", kinds.between), T.jtrim), lambda p: F.length(p) >= 2)
    direction = F.nullif(F.regexp_extract("distance", f"([{kinds.directions}])", 1), F.lit("")) if kinds.directions else F.lit(None).cast("string")
    return anchors.select("route", F.when(number != "", T.numeral(number)).alias("expected"), unit_of("distance", kinds).alias("unit"), direction.alias("direction"), places.alias("places")).where("expected > 0")


def off_routes(found: DataFrame, anchors: DataFrame, kinds: Kinds, slack: float = 0.1) -> DataFrame:
    """doc_id, pos, route, value, expected: distances more than ``slack`` off a route that their context is about.

    A context is about a route if it holds one of its places; a route without
    places is met by every distance.  Units are compared if both are known; a
    route with a direction counts for distances in that direction only.
    """
    rows = found.where("kind = 'distance' and value is not null").select("doc_id", "pos", "value", F.col("unit").alias("_u"), F.col("direction").alias("_d"), "context")
    routes = routes_of(anchors, kinds)
    named = routes.where(F.size("places") > 0).withColumn("key", F.explode("places"))
    # a route without places is keyed by its unit: a distance meets its own unit and none, one without a unit all
    bare = routes.where(F.size("places") == 0).withColumn("key", F.explode(F.array(F.lit("*"), F.coalesce(F.concat(F.lit("* "), F.col("unit")), F.lit("* none")))))
    sizes = _lengths(named, "key")
    own = F.when(F.col("_u").isNull(), F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("* "), F.col("_u")), F.lit("* none")))
    words = F.transform(_pieces("context", sizes), lambda x: x["piece"]) if sizes else F.array().cast("array<string>")
    cut = rows.select("doc_id", "pos", "value", "_u", "_d", F.explode(F.concat(F.array_distinct(words), own)).alias("key"))
    met = cut.join(named.unionByName(bare).drop("places"), "key").drop("key").distinct()
    same = F.col("_u").isNull() | F.col("unit").isNull() | (F.col("_u") == F.col("unit"))
    bad = F.abs(F.col("value") - F.col("expected")) > F.col("expected") * slack
    return met.where(same & bad & (F.col("direction").isNull() | F.col("direction").eqNullSafe(F.col("_d")))).select("doc_id", "pos", "route", "value", "expected")


def close_pairs(hits: DataFrame, *by: str, a: str, b: str, near: int = 50) -> DataFrame:
    """by, a_pos, b_pos: every two hits of the lists ``a`` and ``b`` of ``hits(by, list, pos)`` at most ``near`` apart.

    Both kinds of places are merged into one order; a window over distances gives
    each hit of ``a`` those of ``b`` around it, so nothing further away is met.
    """
    around = Window.partitionBy(*by).orderBy("pos").rangeBetween(-near, near)
    rows = hits.where(F.col("list").isin(a, b)).withColumn("_b", F.collect_list(F.when(F.col("list") == b, F.col("pos"))).over(around))
    return rows.where(F.col("list") == a).select(*by, F.col("pos").alias("a_pos"), F.explode("_b").alias("b_pos"))


def fights(found: DataFrame, kinds: Kinds, near: int = 50) -> DataFrame:
    """doc_id, pos, solo_pos, kill_pos: in the context of each tier, every word of being alone with every word of killing near it (places in the context, from 1).

    A context of daily life, or without a mark of battle, has none.
    """
    rows = found.where("kind = 'tier'").where(~F.col("context").rlike(kinds.daily) & F.col("context").rlike(kinds.battle)).select("doc_id", "pos", "context")
    each = [Lexicon({k: ws}).hits(rows.withColumnRenamed("pos", "at"), "doc_id", "at", text="context", longest=True) for k, ws in (("solo", kinds.solo), ("kill", kinds.kill))]
    pairs = close_pairs(each[0].unionByName(each[1]).distinct(), "doc_id", "at", a="solo", b="kill", near=near)
    return pairs.select("doc_id", F.col("at").alias("pos"), F.col("a_pos").alias("solo_pos"), F.col("b_pos").alias("kill_pos"))


def beyond_tier(found: DataFrame, kinds: Kinds) -> DataFrame:
    """doc_id, pos, tier of the tiers in whose context someone alone kills."""
    pairs = fights(found, kinds).select("doc_id", "pos").distinct()
    return found.where("kind = 'tier'").select("doc_id", "pos", F.col("raw").alias("tier")).join(pairs, ["doc_id", "pos"])


#: Marks of thought, verbs of speech, and quotes before, behind and in the line of a hit.
THOUGHT, SPEECH = "（|\\(|心想|内心|暗道", "说|道|问|答|喊|叫"
OPEN, CLOSE, ANY = '["「『]', '["」』]', '["「『」』]'


def narrated(docs: DataFrame, lists: dict, quotes: str = "「[^」]*」|『[^』]*』|“[^”]*”|\"[^\"]*\"") -> DataFrame:
    """doc_id, term, pos, quoted: occurrences of terms that read as the narrator's own words.

    No quote stands 5 characters around, no mark of thought 10 before, no verb of
    speech 20 before, and the line (as far as 50 characters around show it) holds
    no quote.  ``quoted`` says whether the place lies in a quotation of the text
    nevertheless: the places are held against the intervals of quotations.
    """
    spans = T.spans(F.split("text", quotes, -1), F.regexp_extract_all("text", F.lit(quotes), F.lit(0)))
    intervals = F.transform(spans, lambda x: F.struct(x["pos"].alias("a"), (x["pos"] + F.length(x["found"])).alias("b")))
    rows = docs.select("doc_id", intervals.alias("_q"), Lexicon(lists).around("text", 50).alias("_h"))
    rows = rows.select("doc_id", "_q", F.explode("_h").alias("x")).select("doc_id", "_q", "x.*")
    size = F.length("term")
    rows = rows.select("doc_id", "term", "pos", F.exists("_q", lambda s: (F.col("pos") >= s["a"]) & (F.col("pos") < s["b"])).alias("quoted"), "before", "after")
    whole = F.concat("before", "term", "after")
    # the line ends at the first break behind as many characters as the term has, and begins behind the last break of all
    later = F.instr(F.substring(whole, size + 1, F.length(whole)), F.lit("\n"))
    stop = F.when(later > 0, later + size - 1).otherwise(F.length(whole))
    begin = F.length(whole) - F.length(F.substring_index(whole, "\n", -1))
    line = F.when(stop > begin, F.substring(whole, begin + 1, stop - begin)).otherwise(F.lit(""))
    told = ~F.right("before", F.lit(5)).rlike(OPEN) & ~F.left("after", F.lit(5)).rlike(CLOSE) & ~F.right("before", F.lit(10)).rlike(THOUGHT) & ~line.rlike(ANY) & ~F.right("before", F.lit(20)).rlike(SPEECH)
    return rows.where(told).select("doc_id", "term", F.col("pos").cast("long").alias("pos"), "quoted")
