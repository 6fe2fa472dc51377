"""Registered queries over deltas, anchors and indexes, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.packs import ZH, Pack
from ..operators import anchors as A
from ..operators import deltas as E
from ..operators import postings as N
from ..operators import schemas as J
from ..operators import scores as X
from ..operators import structure as S
from ..operators import triggers as G
from . import oracle as O


def event_deltas(events: DataFrame) -> DataFrame:
    """Events as deltas: a user's events in order are attempts at the chapters of a book, five for each."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events.select(F.col("user_id").cast("string").alias("book"), F.col("event_id").alias("seq"), n.alias("n"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    ident = F.when(F.col("k") % 23 == 0, "x").otherwise(F.concat(F.lit("c"), F.col("k") % 3))
    lives = F.array(F.struct(ident.alias("id"), F.when(F.col("k") % 10 == 0, False).when(F.col("k") % 10 == 1, True).alias("alive"), F.when(F.col("k") % 29 == 0, "high").otherwise("low").alias("combat_level")))
    ages = F.struct(F.when(F.col("k") % 4 == 0, F.create_map(ident, (20 + F.col("n") + F.col("k") % 5).cast("double"))).alias("character_age"))
    action = F.when(F.col("k") % 31 == 0, "burn").otherwise(F.element_at(F.array(*map(F.lit, E.ACTIONS)), (F.col("k") % 4 + 1).cast("int")))
    ops = F.array(F.struct(F.concat(F.lit("f"), F.col("k") % 6).alias("id"), action.alias("action"), F.concat(F.lit("s"), F.col("k")).alias("summary")))
    none = F.lit(None)
    delta = F.struct(lives.alias("character_states"), ages.alias("number_anchors_updated"), ops.alias("foreshadowing_ops"), none.alias("knowledge_boundary_updates"), none.alias("timeline")).cast(E.DELTA)
    return rows.select("book", "seq", F.floor((F.col("n") + 4) / 5).alias("chapter"), delta.alias("delta"))


def event_books(events: DataFrame) -> DataFrame:
    """What the books of ``event_deltas`` know; those with an even name have tiers."""
    even = F.col("user_id") % 2 == 0
    words = lambda *x: F.array(*map(F.lit, x))
    return events.select("user_id").distinct().select(F.col("user_id").cast("string").alias("book"), words("c0", "c1", "c2").alias("characters"), words("f0", "f1", "f2", "f3", "f4").alias("foreshadowing"), words("low", "mid", "high").alias("tiers"), F.when(even, "mid").alias("max_tier"))


RULED_SQL = """with recursive e as (select user_id, event_id as seq, row_number() over (partition by user_id order by event_id) as n, json_extract_string(props, '$.k')::bigint as k from events),
d as (select *, (n + 4) // 5 as chapter, case when k % 23 = 0 then 'x' else 'c' || (k % 3) end as id, case when k % 10 = 0 then false when k % 10 = 1 then true end as alive, case when k % 29 = 0 then 'high' else 'low' end as level,
  case when k % 4 = 0 then (20 + n + k % 5)::double end as age, 'f' || (k % 6) as fid, case when k % 31 = 0 then 'burn' else (['plant', 'advance', 'reap', 'hint'])[k % 4 + 1] end as action from e),
s as (select *, [case when action = 'burn' then 'action burn' end, case when id = 'x' then 'unknown character x' end, case when fid = 'f5' and action <> 'plant' then 'unknown foreshadowing f5' end, case when user_id % 2 = 0 and level = 'high' then 'tier ' || id end] as own from d),
r as (select user_id, 0::bigint as n, 0::bigint as last, []::varchar[] as dead, null::varchar as old_id, null::double as old_age, null::bigint as seq, null::bigint as chapter, []::varchar[] as errors from (select distinct user_id from e)
  union all
  select user_id, n, case when ok then chapter else last end, case when ok and alive = false then list_append(dead, id) else dead end, case when ok and age is not null then id else old_id end, case when ok and age is not null then age else old_age end, seq, chapter, errors
  from (select *, len(errors) = 0 as ok from (select s.user_id, s.n, s.seq, s.chapter, s.id, s.alive, s.age, r.last, r.dead, r.old_id, r.old_age,
    list_filter(list_concat(s.own, [case when s.chapter <> r.last + 1 then 'continuity ' || (r.last + 1) end, case when s.alive and list_contains(r.dead, s.id) then 'resurrection ' || s.id end, case when s.age < r.old_age and s.id = r.old_id then 'age ' || s.id end]), lambda x: x is not null) as errors
    from r join s on s.user_id = r.user_id and s.n = r.n + 1))),
ruled as (select user_id::varchar as book, seq, chapter, case when len(errors) = 0 then 'synced' else 'degraded' end as status, array_to_string(list_sort(errors), ', ') as errors from r where n > 0),
ok as (select d.* from d join ruled using (seq) where status = 'synced')
"""


def number_value(s: str) -> str:
    """SQL for the worth of a numeral of digits, or of a Chinese one below a thousand."""
    digit = lambda x: f"(case {x} when '两' then 2 else coalesce(list_position(['一', '二', '三', '四', '五', '六', '七', '八', '九'], nullif({x}, '')), 0) end)"
    one = "([一二两三四五六七八九])"
    part = lambda mark, worth: f"(case when contains({s}, '{mark}') then greatest({digit(f'''regexp_extract({s}, '{one}{mark}', 1)''')}, 1) * {worth} else 0 end)"
    last = f"""regexp_extract({s}, '{one}$', 1)"""
    return f"(case when {s} = '' then null when regexp_matches({s}, '^[0-9]+$') then try_cast({s} as double) else ({part('百', 100)} + {part('十', 10)} + {digit(last)})::double end)"


def unit_sql(c: str, kinds: A.Kinds) -> str:
    cases = " ".join(f"when {O.any_of(c, names)} then {O.q(unit)}" for unit, names in sorted(kinds.units.items(), key=lambda u: -len(u[0])))
    return f"(case {cases} end)"


def numbers_sql(kinds: A.Kinds, tiers: tuple) -> str:
    """CTE m: the numbers of all kinds."""
    patterns = [(kind, i, *p) for kind, ps in kinds.patterns.items() for i, p in enumerate(ps)] + ([("tier", 0, "|".join(tiers), 0, 0)] if tiers else [])
    group = lambda p, g: f"regexp_extract(x.found, {O.re2(p)}, {g})" if g else "''"
    each = " union all ".join(f"select doc_id, text, '{kind}' as kind, {i} as i, x.pos as pos, x.found as raw, {group(p, v)} as number, {group(p, d)} as direction from (select doc_id, text, unnest({O.spans('text', p)}) as x from documents where regexp_matches(text, {O.re2(p)}))" for kind, i, p, v, d in patterns)
    return f"""m0 as ({each}),
m1 as (select * from m0 qualify row_number() over (partition by doc_id, kind, pos order by i) = 1),
m2 as (select doc_id, kind, pos, raw, {number_value('number')} as value, case when kind = 'distance' then {unit_sql('raw', kinds)} end as unit, nullif(direction, '') as direction, substr(text, greatest(pos - 50, 1), pos + length(raw) + 50 - greatest(pos - 50, 1)) as context from m1),
m as (select *, substr(context, 1, strpos(context, raw) - 1) as before from m2)
"""


def anchored_sql(kind: str, people: list[tuple], column: int) -> str:
    values = ", ".join(f"({O.q(p[0])}, {O.q(p[1])}, {p[column]}::double)" for p in people)
    longer = " or ".join(f"(p.name = {O.q(a)} and starts_with(substr(before, spot), {O.q(b)}))" for a, *_ in people for b, *_ in people if b != a and b.startswith(a)) or "false"
    return f"""select distinct doc_id, pos, main as name, value, expected from (select doc_id, pos, value, before, unnest(range(1, length(before) + 1)) as spot from m where kind = '{kind}' and value is not null), (values {values}) p(name, main, expected)
where starts_with(substr(before, spot), p.name) and not ({longer}) and expected > 0 and value <> expected"""


def routes_sql(kinds: A.Kinds, routes: list[tuple]) -> str:
    number = r"regexp_extract(distance, '(?:[0-9]|[一二两三四五六七八九十百])+')"
    direction = f"nullif(regexp_extract(distance, '([{kinds.directions}])', 1), '')"
    values = ", ".join(f"({O.q(a)}, {O.q(b)})" for a, b in routes)
    return f"""r as (select route, {number_value(number)} as expected, {unit_sql('distance', kinds)} as ru, {direction} as rd, list_filter(regexp_split_to_array(route, {O.q(kinds.between)}), lambda x: length(x) >= 2) as places from (values {values}) t(route, distance))
select doc_id, pos, route, value, expected from m, r where kind = 'distance' and value is not null and expected > 0 and (unit is null or ru is null or unit = ru) and (len(places) = 0 or len(list_filter(places, lambda p: contains(context, p))) > 0)
and abs(value - expected) > expected * 0.1::double and (rd is null or rd = direction)"""


def fights_sql(kinds: A.Kinds) -> str:
    """CTE f: the pairs of words in the contexts of tiers."""
    return f"""c as (select doc_id, pos, context from m where kind = 'tier' and not regexp_matches(context, '{kinds.daily}') and regexp_matches(context, '{kinds.battle}')),
a as (select doc_id, pos, unnest({O.spans('context', '|'.join(kinds.solo))}).pos as solo_pos from c), b as (select doc_id, pos, unnest({O.spans('context', '|'.join(kinds.kill))}).pos as kill_pos from c),
f as (select doc_id, pos, solo_pos, kill_pos from a join b using (doc_id, pos) where abs(solo_pos - kill_pos) <= 50)
"""


def narrated_sql(grades: dict) -> str:
    import re

    hits = " union all ".join(f"select doc_id, text, {O.q(w)} as term, x.pos as pos from (select doc_id, text, unnest({O.spans('text', re.escape(w))}) as x from documents where contains(text, {O.q(w)}))" for w in dict.fromkeys(w for ws in grades.values() for w in ws))
    quotes = "「[^」]*」|『[^』]*』|“[^”]*”|\"[^\"]*\""
    return f"""with h as ({hits}),
h1 as (select *, substr(text, greatest(pos - 50, 1), pos - greatest(pos - 50, 1)) as before, substr(text, pos + length(term), 50) as after from h),
h2 as (select *, before || term || after as whole from h1),
h3 as (select *, length(whole) - length(list_last(string_split(whole, chr(10)))) as begin_, strpos(substr(whole, length(term) + 1), chr(10)) as later from h2),
h4 as (select *, case when later > 0 then later + length(term) - 1 else length(whole) end as stop from h3),
h5 as (select *, case when stop > begin_ then substr(whole, begin_ + 1, stop - begin_) else '' end as line from h4)
select doc_id, term, pos::bigint as pos, len(list_filter({O.spans('text', quotes)}, lambda s: pos >= s.pos and pos < s.pos + length(s.found))) > 0 as quoted from h5
where not regexp_matches(right(before, 5), {O.q(A.OPEN)}) and not regexp_matches(left(after, 5), {O.q(A.CLOSE)}) and not regexp_matches(right(before, 10), {O.q(A.THOUGHT)}) and not regexp_matches(line, {O.q(A.ANY)}) and not regexp_matches(right(before, 20), '{A.SPEECH}')"""


#: (name, main, age, cultivation) and (route, distance) of the queries, by script.
PEOPLE = {
    True: [("张三", "张三", 20, 3), ("张三丰", "张三丰", 100, 9), ("三爷", "张三", 20, 3), ("李四", "李四", 0, 5)],
    False: [("the", "the", 30, 5), ("there", "there", 30, 5), ("de", "de", 40, 7), ("und", "de", 40, 7), ("is", "is", 0, 7)],
}
ROUTES = {True: [("东山-西山", "南100里"), ("天城到海城", "50公里"), ("r-1", "十里"), ("a", "七")], False: [("License-Version", "C 3."), ("token", "10-"), ("a-b", "5."), ("x", "77")]}
TIERS = ("炼气", "筑基", "金丹")


#: A schema with references and combinations, for JSON made of events.
PARTS = {
    "type": "object", "required": ["kind", "n"], "additionalProperties": False,
    "properties": {
        "kind": {"enum": ["click", "view", "purchase", "signup", "bad"]}, "n": {"oneOf": [{"minimum": 50}, {"maximum": 60}]}, "of": {"$ref": "#/definitions/part"},
        "list": {"items": {"anyOf": [{"type": "integer", "maximum": 3}, {"type": "string", "minLength": 2}]}},
    },
    "definitions": {"part": {"type": "object", "properties": {"kind": {"$ref": "#/properties/kind"}, "n": {"allOf": [{"minimum": 2}, {"maximum": 17}]}}}},
}


def event_parts(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.concat(
        F.lit('{"kind":"'), "event_type", F.lit('","n":'), k, F.lit(',"of":{"kind":"'), F.when(k % 3 == 0, "none").otherwise(F.col("event_type")), F.lit('","n":'), k % 20, F.lit("}"),
        F.when(k % 5 == 0, ',"extra":1').otherwise(""), F.lit(',"list":['), k % 7, F.lit(',"'), k, F.lit('"]}'),
    )
    return events.select("event_id", text.alias("j"))


#: Patterns of names in Latin-script corpora, names that are known, and what is looked up.
NAMES = {"tagged": "([A-Z][a-z]{2,7}) (?:said|und|avec|con|with)", "upper": "([A-Z]{3,8})", "key": "(token|icense)"}
KNOWN, STOPPED, ASKED = ("The", "License"), ("And", "MIT"), ("token", "License", "HE", "e", "AREX", "zzz", "tokens of The")


def documents_as_files(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("chapter"), F.col("source"), "text")


def postings_sql() -> str:
    """CTE p: every name with its place."""
    known = [("character", i - 10, w, None) for i, w in enumerate(KNOWN)]
    patterns = [(k, i, p, p) for i, (k, p) in enumerate(NAMES.items())]
    each = " union all ".join(f"select doc_id, text, '{kind}' as kind, {i} as i, x.pos as pos, {f'regexp_extract(x.found, {O.q(p)}, 1)' if by else 'x.found'} as keyword from (select doc_id, text, unnest({O.spans('text', p)}) as x from documents where regexp_matches(text, {O.q(p)}))" for kind, i, p, by in known + patterns)
    stopped, names = (", ".join(map(O.q, x)) for x in (STOPPED, KNOWN))
    return f"""with n as ({each}),
k as (select * from n where keyword not in ({stopped}) and (keyword in ({names}) or left(keyword, 1) not in ('S', 'W')) qualify row_number() over (partition by doc_id, keyword, pos order by i) = 1),
c as (select *, trim(regexp_replace(substr(text, greatest(pos - 30, 1), pos + length(keyword) + 30 - greatest(pos - 30, 1)), '\\r?\\n', ' ', 'g'), ' ') as around from k),
p as (select keyword, kind, doc_id::varchar as file, doc_id as chapter, length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) + 1 as line, pos, case when length(around) > 80 then substr(around, 1, 77) || '...' else around end as context from c)
"""


#: Conditions as a project writes them, and the same in SQL over the contexts of ``document_contexts``.
CONDITIONS = [
    ("always", "base", "always", "true"), ("scenes", "base", "scene_type in [core, Important]", "n_chars % 3 < 2"), ("quiet", "base", "scene_type == transitional and dialogue_ratio > 40", "n_chars % 3 = 2 and n_chars % 100 > 40"),
    ("tag", "base", "内容标签 = we", "contains(source, 'we')"), ("new", "base", "新角色登场", "doc_id % 5 = 0"), ("step", "步骤触发集", "03b 质检", "doc_id % 4 = 0"), ("or", "base", 'genre == "en" or "fr"', "lang in ('en', 'fr')"),
    ("list", "base", "genre in [de, es] and dialogue_ratio > 50", "lang in ('de', 'es') and n_chars % 100 > 50"), ("early", "02a 模块", "首批建纲（前10章）", "doc_id % 4 = 3 and doc_id % 20 <= 10"), ("later", "02a 模块", "滚动补纲", "doc_id % 4 = 3 and doc_id % 20 > 10"),
    ("opening", "02a 模块", "卷首章", "doc_id % 4 = 3 and doc_id % 20 = 15"), ("hand", "02a 模块", "发现细纲变对话脚本", "false"),
]


def document_contexts(d: DataFrame) -> DataFrame:
    """Documents as chapters in a state of work."""
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (n + 1).cast("int"))
    i = F.col("doc_id")
    return d.select(
        i.alias("id"), pick(F.col("n_chars") % 3, "core", "important", "transitional").alias("scene"), F.col("source").alias("content_tag"), (F.col("n_chars") % 100).alias("dialogue_ratio"), (i % 5 == 0).alias("new_character"),
        pick(i % 4, "03b", "04", "05", "02a").alias("step"), F.col("lang").alias("genre"), (i % 20).alias("chapter"), F.when(i % 20 == 15, "opening").alias("chapter_type"),
    )


def register(P: Pack, words: tuple, over_documents: Callable, over_tables: Callable) -> None:
    """Adds the queries of this module."""
    chinese = P is ZH
    kinds, tiers = (A.ZH, TIERS) if chinese else (A.LATIN, A.LATIN.tiers)
    from dataclasses import replace

    kinds = replace(kinds, tiers=tiers)
    people, routes = PEOPLE[chinese], ROUTES[chinese]
    frame = lambda spark, rows, shape: spark.createDataFrame(rows, shape)
    who = lambda d: frame(d.sparkSession, people, "name string, main string, age int, cultivation int")
    found = "with " + numbers_sql(kinds, tiers)

    over_documents("kinds_of_numbers", lambda d: A.numbers(d, kinds).drop("context"), found + "select doc_id, kind, pos, raw, value, unit, direction, before from m")
    over_documents("age_anchors", lambda d: A.anchored(A.numbers(d, kinds, "age"), who(d), "age", "age"), found + anchored_sql("age", people, 2))
    over_documents("cultivation_anchors", lambda d: A.anchored(A.numbers(d, kinds, "cultivation"), who(d), "cultivation", "cultivation"), found + anchored_sql("cultivation", people, 3))
    over_documents("route_distances", lambda d: A.off_routes(A.numbers(d, kinds, "distance"), frame(d.sparkSession, routes, "route string, distance string"), kinds), found.rstrip() + ",\n" + routes_sql(kinds, routes))
    over_documents("lone_fights", lambda d: A.fights(A.numbers(d, kinds, "tier"), kinds), found.rstrip() + ",\n" + fights_sql(kinds) + "select doc_id, pos, solo_pos, kill_pos from f")
    over_documents("beyond_tier", lambda d: A.beyond_tier(A.numbers(d, kinds, "tier"), kinds), found.rstrip() + ",\n" + fights_sql(kinds) + "select distinct doc_id, pos, raw as tier from m join f using (doc_id, pos) where kind = 'tier'")
    over_documents("narrator_overreach", lambda d: A.narrated(d, P.grades), narrated_sql(P.grades))

    def issues(d: DataFrame) -> DataFrame:
        """doc_id, issues: numbers and routes against their anchors."""
        parts = [A.anchored(A.numbers(d, kinds, "age"), who(d), "age", "age"), A.anchored(A.numbers(d, kinds, "cultivation"), who(d), "cultivation", "cultivation"), A.off_routes(A.numbers(d, kinds, "distance"), frame(d.sparkSession, routes, "route string, distance string"), kinds)]
        each = [p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("issues")) for p in parts]
        return each[0].unionByName(each[1]).unionByName(each[2])

    age, cultivation, route = (sql.removeprefix(found) for sql in (found + anchored_sql("age", people, 2), found + anchored_sql("cultivation", people, 3), routes_sql(kinds, routes)))
    route_cte, route_rows = route.split("\nselect", 1)
    total = "plot + rhythm + texture + consistency + baseline"
    over_documents(
        "anchored_score",
        lambda d: X.objective_scores(d, P, words, issues(d)),
        f"with {O.lines(P)},\n{O.scores(P, words)},\n{numbers_sql(kinds, tiers)},\n{route_cte}, i as (select doc_id, count(*) as issues from (select doc_id from ({age}) union all select doc_id from ({cultivation}) union all select doc_id from (select{route_rows})) group by doc_id), "
        + "t as (select s.* replace ((case when coalesce(issues, 0) = 0 then 10 when issues <= 2 then 7 when issues <= 5 then 3 else 0 end)::bigint as consistency) from score s left join i using (doc_id)) "
        + f"select *, ({total})::bigint as total, {O.route(total)} as flow from t",
    )

    ruled = lambda t: E.rulings(event_deltas(t("events")), event_books(t("events")))
    synced = lambda t: E.accepted(event_deltas(t("events")), ruled(t))
    over_tables("delta_rulings", lambda t: ruled(t).withColumn("errors", F.array_join("errors", ", ")), RULED_SQL + "select * from ruled")
    over_tables("character_state", lambda t: E.character_state(synced(t)), RULED_SQL + "select user_id::varchar as book, id, arg_max(alive, seq) as alive, arg_max(level, seq) as combat_level from ok group by user_id, id")
    over_tables(
        "foreshadowing_state",
        lambda t: E.foreshadowing_state(synced(t)),
        RULED_SQL + ", p as (select *, min(case when action = 'plant' then seq end) over (partition by user_id, fid) as planted from ok) select user_id::varchar as book, fid as id, arg_max(action, seq) as status, arg_min(chapter, seq) as planted_chapter, max(chapter) as last_updated_chapter, 's' || arg_max(k, seq) as last_summary from p where seq >= planted group by user_id, fid",
    )
    over_tables("age_state", lambda t: E.age_state(synced(t)), RULED_SQL + "select user_id::varchar as book, arg_max(id, seq) as id, arg_max(age, seq) as age from ok where age is not null group by user_id")
    over_documents(
        "due_checks",
        lambda d: E.due_checks(S.chapters(d.select("source", "doc_id"))),
        "with recursive c as (select source as book, row_number() over (partition by source order by doc_id) as chapter_no from documents), f as (select book, min(chapter_no) as chapter_no, 0::bigint as since from c where chapter_no >= 5 group by book union all select f.book, min(c.chapter_no), f.chapter_no from f join c on c.book = f.book and c.chapter_no >= f.chapter_no + 5 group by f.book, f.chapter_no) select * from f",
    )
    index = lambda d: N.postings(documents_as_files(d), KNOWN, NAMES, STOPPED, "SW")
    over_documents("name_postings", lambda d: index(d).drop("source"), postings_sql() + "select * from p")

    def looked_up(d: DataFrame) -> DataFrame:
        found = index(d)
        asked = d.sparkSession.createDataFrame([(q,) for q in ASKED], "query string")
        return N.look_up(asked, found, N.keyword_grams(found)).groupBy("query", "keyword", "exact").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("file").alias("files"))

    over_documents(
        "index_lookup",
        looked_up,
        postings_sql() + f"select query, keyword, query = keyword as exact, count(*) as places, count(distinct file) as files from p join (values {', '.join(f'({O.q(q)})' for q in ASKED)}) a(query) on contains(keyword, query) or contains(query, keyword) group by all",
    )
    over_documents(
        "context_triggers",
        lambda d: G.loaded(d.sparkSession.createDataFrame([c[:3] for c in CONDITIONS], "trigger string, section string, condition string"), document_contexts(d)),
        " union all ".join(f"select doc_id as id, '{name}' as trigger from documents where {sql}" for name, _, _, sql in CONDITIONS),
    )
    known = "event_type in ('click', 'view', 'purchase', 'signup', 'bad')"
    wrong = [("$.kind", "enum", f"not {known}"), ("$.n", "oneOf", "k between 50 and 60"), ("$.of.kind", "enum", f"k % 3 = 0 or not {known}"), ("$.of.n", "minimum", "k % 20 < 2"), ("$.of.n", "maximum", "k % 20 > 17"), ("$.extra", "additionalProperties", "k % 5 = 0"), ("$.list[0]", "anyOf", "k % 7 > 3"), ("$.list[1]", "anyOf", "k < 10")]
    over_tables(
        "schema_errors",
        lambda t: J.schema_errors(event_parts(t("events")), "event_id", "j", PARTS),
        "with e as (select event_id, event_type, json_extract_string(props, '$.k')::bigint as k from events) " + " union all ".join(f"select event_id, '{path}' as path, '{error}' as error from e where {when}" for path, error, when in wrong),
    )
