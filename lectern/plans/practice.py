"""Registered queries over rules, packets between chapters, open threads and versions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packs import ZH, Pack
from ..operators import handoffs as H
from ..operators import rhythm as Y
from ..operators import rules as U
from ..operators import usage as G
from ..operators.scan import LIFT, PAIR, Scan
from . import oracle as O

#: A project's registry: all rules, two of them turned off.
REGISTRY = tuple((r, r not in ("R006", "R023")) for r in U.ALL)


def states_sql(P: Pack, words: tuple) -> str:
    """CTE st: the state of each rule of REGISTRY for each text."""
    L, (n, _, cv) = P.lists, O.spread("v")
    tokens = "regexp_extract_all(full_, '[A-Za-z0-9]+|[一-鿿]')"
    ttr = "case when len(t) < 50 then 0 when len(t) < 500 then len(list_distinct(t))::double / len(t) else list_min(list_transform(range(0, len(t) // 500), lambda i: len(list_distinct(t[i * 500 + 1 : i * 500 + 500]))::double / 500)) end"
    simple = lambda rule, c, most, failure: f"select doc_id, '{rule}' as rule, {c}::double as x, {c} <= {most} as ok, {failure} as fail from rf"
    parts = [
        simple("R001", "neg", 0, "'blocking'"),
        simple("R002", "dashes", 4, "case when dashes >= 8 then 'blocking' else 'advisory' end"),
        simple("R003", "dense", 3, "case when dense > 4 then 'blocking' else 'advisory' end"),
        simple("R005", O.terms("told", L["ban_a"]), 0, "'blocking'"),
        "select doc_id, 'R009', case when len(v) >= 8 then cv end, len(v) < 8 or cv >= 0.35, 'blocking' from rf",
        simple("R010", O.terms("told", L["emotion_direct"]), 2, "'advisory'"),
        "select doc_id, 'R013', (starts + times)::double, starts = 0 and times < 2, 'advisory' from rf",
        f"select doc_id, 'R018', case when length(full_) >= 200 then {ttr} end, length(full_) < 200 or {ttr} >= 0.25, 'advisory' from rf",
        f"select doc_id, 'R019', (case when length(told) >= 200 then {O.terms('told', L['transitions'])} else 0 end)::double, length(told) < 200 or {O.terms('told', L['transitions'])} < 5, 'advisory' from rf",
        "select doc_id, 'R020', case when length(full_) >= 1000 then var end, length(full_) < 1000 or var >= 0.002, 'advisory' from rf",
    ]
    limits = " ".join(f"when '{r}' then {m}" for r, m in U.LIMITS.items())
    idle = [("R006", "disabled", None), ("R023", "disabled", None), *((r, "skipped", "requires_external_script") for r in U.EXTERNAL), *((r, "skipped", "manual_check_required") for r in U.MANUAL if r != "R023"), ("R025", "skipped", "no_checker_defined")]
    rest = ", ".join(f"('{r}', '{s}', {O.q(why) if why else 'null'})" for r, s, why in idle)
    return f"""with {O.lines(P).strip()},
rv as (select doc_id, list(n) filter (where n > 0) as v from (select doc_id, len(regexp_extract_all(unnest({O.sents('narrative', P)}), {O.q(P.visible)})) as n from nl) group by doc_id),
ra as (select doc_id, array_to_string(list(line order by line_no), chr(10)) as all_, array_to_string(list(line order by line_no) filter (where not blank and not structural), '') as full_ from p group by doc_id),
rn as (select doc_id, sum(case when a > 0 then a else least(b, 1) end) as neg, list(substr(narrative, 1, 2) order by line_no) as s from (select *, {O.count('narrative', PAIR)} as a, {O.count('narrative', LIFT)} as b from nl where visible > 0) group by doc_id),
r0 as (select d.doc_id, coalesce(all_, '') as all_, coalesce(full_, '') as full_, coalesce(nt.narrative, '') as told, coalesce(v, []) as v, coalesce(neg, 0) as neg, coalesce(s, []) as s
  from documents d left join ra using (doc_id) left join nt using (doc_id) left join rv using (doc_id) left join rn using (doc_id)),
r1 as (select *, {O.count('all_', '——|—|--+')} as dashes, {O.terms('all_', L['vague_time'])} as times, {n} as n, {cv} as cv, {tokens} as t,
  coalesce(({' + '.join(O.count('told', p) for p in P.similes)}) * 1000.0::double / nullif({O.count('told', P.visible)}, 0), 0) as dense,
  len(list_filter(range(1, len(s) - 1), lambda i: s[i] = s[i + 1] and s[i + 1] = s[i + 2])) as starts, {O.densities('full_', P, words)} as d from r0),
r2 as (select *, list_sum(d) / nullif(len(d), 0) as m from r1),
rf as (select *, coalesce(list_sum(list_transform(d, lambda x: (x - m) * (x - m))) / nullif(len(d), 0), 0) as var from r2),
rx as ({' union all '.join(parts)}),
st as (select doc_id, rule, case when ok then 'passed' else 'failed' end as status, null::varchar as reason, {O.scaled('x')} as actual, (case rule {limits} end)::bigint as threshold, case when ok then 'info' else fail end as severity from rx
  union all select doc_id, r.rule, r.status, r.reason, null, null, 'info' from documents, (values {rest}) r(rule, status, reason))
"""


def event_chapters(events: DataFrame) -> DataFrame:
    """Events as chapters that each hand over a packet; a user's events are a book."""
    k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    people = text("[角色当前状态]\n| 角色 | 位置 |\n|---|---|\n| c", k % 5, " | p", k % 7, " | b", i % 3, " |\n")
    threads = text("[伏笔]\n├─ t", k % 11, F.when(k % 3 == 0, "（已回收）").otherwise(""), "\n└─ u", k % 4, "\n")
    rest = text("[禁止矛盾]\n├─ ❌ f", k % 6, "\n说明\n[状态锁定]\nc", k % 5, " → s", k % 2, "\n【数值锁定】\ng = ", k % 8)
    return events.select(F.col("user_id").alias("book"), i.alias("chapter"), text("引子\n", F.when(k % 2 == 0, "【衔接包】\n").otherwise("[衔接包 V1]\n"), people, threads, rest).alias("text"))


def versioned_texts() -> Column:
    """Texts of files that name a version in one way or another, or far down."""
    i = F.col("doc_id")
    named = F.when(i % 3 == 0, F.concat(F.lit("version: v"), i % 5, F.lit(".1\n"))).when(i % 3 == 1, F.concat(F.lit("see V"), i % 4, F.lit(".0.2 of it\n"))).otherwise("")
    return F.concat(F.lit("# "), F.col("source"), F.lit("\n"), named, F.repeat(F.lit("\n"), (i % 40).cast("int")), F.lit("版本：V9.9"))


def tracker_texts(orders: DataFrame) -> DataFrame:
    """Orders as files that track a thread each, with a title, a rule of a table, and signs or words of its state."""
    marks = ("🟢 ", "🟡 ", "🔴 ", "⚫\ufe0f ", "已回收 ", "active ", "Warning ", "过期 ", "")
    state = F.element_at(F.array(*map(F.lit, marks)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return orders.select((F.col("o_custkey") % 7).alias("book"), F.concat(F.lit("# 🟢 title\n| --- | active |\n├─ "), state, F.lit("o"), F.col("o_orderkey").cast("string")).alias("text"))


#: CTEs up to ``old``: the packets of ``event_chapters`` that are compacted.  A packet under 【 ends before the next 【, so it has no locked values.
OLD_SQL = """with e as (select user_id as book, event_id as chapter, json_extract_string(props, '$.k')::bigint as k from events),
c as (select *, count(*) over (partition by book) as n, row_number() over (partition by book order by chapter desc) as r from e),
b as (select *, 'c' || (k % 5) as name, 't' || (k % 11) || case when k % 3 = 0 then '（已回收）' else '' end as t, 'u' || (k % 4) as u, 'f' || (k % 6) as f, 'c' || (k % 5) || ' → s' || (k % 2) as l, 'g = ' || (k % 8) as g from c where n > 10 and r > 3),
old as (select *, '[角色当前状态]' || chr(10) || '| 角色 | 位置 |' || chr(10) || '|---|---|' || chr(10) || '| ' || name || ' | p' || (k % 7) || ' | b' || (chapter % 3) || ' |' || chr(10) || '[伏笔]' || chr(10) || '├─ ' || t || chr(10) || '└─ ' || u || chr(10) || '[禁止矛盾]' || chr(10) || '├─ ❌ ' || f || chr(10) || '说明' || chr(10) || '[状态锁定]' || chr(10) || l || chr(10) as body from b),
i0 as (select book, chapter, case when contains(t, '已回收') then 'resolved' else 'active' end as kind, '─ ' || t as item, 1 as line from old union all select book, chapter, 'active', '─ ' || u, 2 from old union all select book, chapter, 'forbidden', '─  ' || f, 1 from old union all select book, chapter, 'state_lock', l, 1 from old union all select book, chapter, 'value_lock', g, 1 from old where k % 2 = 1),
i1 as (select book, kind, item, min(chapter) as chapter from i0 group by book, kind, item),
s as (select book, name, arg_max('p' || (k % 7), chapter) as location, arg_max('b' || (chapter % 3), chapter) as body, '' as mind, '' as items, '' as power, '' as alive, max(chapter) as chapter from old group by book, name)
"""


def register(P: Pack, words: tuple, over_documents: Callable, over_tables: Callable) -> None:
    """Adds the queries of this module."""
    scan, sql = Scan(P, words), states_sql(P, words)
    over_documents("rule_states", lambda d: U.rule_states(d, scan, REGISTRY), sql + "select * from st")
    over_documents(
        "execution_rates",
        lambda d: U.execution_rates(U.rule_states(d, scan, REGISTRY)),
        sql + "select *, case when passed + failed = 0 then 0 else " + O.scaled("passed::double / (passed + failed)", "1000") + " end as rate from (select doc_id, count(*) as rules, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in ("passed", "failed", "skipped", "disabled"))
        + ", " + ", ".join(f"bool_or(status = 'failed' and severity = '{s}') as {s}" for s in ("blocking", "advisory")) + " from st group by doc_id)",
    )
    old = lambda t: H.to_compact(H.packets(event_chapters(t("events"))))
    over_tables("packet_items", lambda t: H.kept_items(old(t)).drop("line"), OLD_SQL + "select * from i1")
    over_tables("packet_characters", lambda t: H.last_states(old(t)), OLD_SQL + "select * from s")
    over_tables(
        "packet_summaries",
        lambda t: H.summaries(old(t)),
        OLD_SQL + """, a as (select book, min(chapter) as first, max(chapter) as last, count(*) as packets, sum(case when k % 2 = 0 then length('【衔接包】' || chr(10) || body) else length('[衔接包 V1]' || chr(10) || body || '【数值锁定】' || chr(10) || g) end)::bigint as raw_length from old group by book),
j as (select book, """ + ", ".join(f"count(*) filter (where kind = '{k}') as {k}" for k in ("active", "resolved", "forbidden", "state_lock", "value_lock")) + """, sum(length(item)) as chars from i1 group by book),
p as (select book, count(*) as characters, sum(length(name) + length(location) + length(body)) as own from s group by book)
select a.*, j.* exclude (book, chars), characters, floor((chars + own) * 100.0::double / greatest(raw_length, 1) + 0.5)::bigint as percent_kept from a join j using (book) join p using (book)""",
    )
    lines = lambda o: o.select((F.col("o_custkey") % 7).alias("book"), F.concat_ws("\n", F.concat_ws(" ", F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("DONE"), F.concat(F.lit("第"), F.col("o_orderkey") % 90, F.lit("章"))), F.concat(F.lit("ACTIVE 第3章 提到，埋设于第"), F.col("o_orderkey") % 70, F.lit("章"))).alias("text"))
    over_tables(
        "overdue_threads",
        lambda t: H.overdue_lines(lines(t("orders")), t("customer").select((F.col("c_custkey") % 7).alias("book"), (F.col("c_custkey") % 101).alias("chapter"))),
        "with n as (select c_custkey % 7 as book, max(c_custkey % 101) as newest from customer group by 1), l as (select o_custkey % 7 as book, 1 as line_no, o_orderkey % 90 as start from orders where o_orderstatus = 'O' union all select o_custkey % 7, 2, o_orderkey % 70 from orders) select book, line_no::bigint as line_no, start, newest - start as age from l join n using (book) where start > 0 and newest - start > 50",
    )
    over_documents(
        "recent_pass_rates",
        lambda d: H.recent_rates(d.select(F.col("source").alias("book"), "doc_id"), U.execution_rates(U.rule_states(d, scan, REGISTRY))),
        sql + ", x as (select doc_id, count(*) filter (where status = 'passed') as a, count(*) filter (where status = 'failed') as b from st group by doc_id) select source as book, doc_id, case when a + b = 0 then 0 else " + O.scaled("a::double / (a + b)", "1000") + " end as rate from documents join x using (doc_id) qualify row_number() over (partition by source order by doc_id desc) <= 10",
    )
    tracked = lambda t: H.tracked_threads(tracker_texts(t("orders")))
    threads = """with o as (select *, o_orderkey % 9 as k, o_custkey % 7 as book from orders), t as (select book, 3::bigint as line_no, (['green', 'yellow', 'red', 'black', 'black', 'green', 'yellow', 'red'])[k + 1] as status, (['─  o', '─  o', '─  o', '─  o', '─ 已回收 o', '─ active o', '─ Warning o', '─ 过期 o'])[k + 1] || o_orderkey as text from o where k < 8)
"""
    over_tables("tracked_threads", tracked, threads + "select * from t")
    over_tables("thread_board", lambda t: H.thread_board(tracked(t)), threads + "select book, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in H.SIGNS) + " from t group by book")
    over_documents("reading_order", lambda d: H.in_reading_order(d.select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 5 > 0, F.size(F.split("text", "\n", -1)).cast("long")).otherwise(-1).alias("lines"))), "select doc_id as file, case when doc_id % 5 > 0 then length(text) - length(replace(text, chr(10), '')) + 1 else -1 end as lines from documents")
    over_documents(
        "header_versions",
        lambda d: d.select("doc_id", H.header_version(versioned_texts()).alias("version")),
        "select doc_id, case when doc_id % 3 = 0 then 'V' || (doc_id % 5) || '.1' when doc_id % 40 + (case when doc_id % 3 = 1 then 2 else 1 end) < 30 then 'V9.9' when doc_id % 3 = 1 then 'V' || (doc_id % 4) || '.0.2' end as version from documents",
    )

    bank, images = (G.ZH_BANK, G.ZH_IMAGES) if P is ZH else (G.LATIN_BANK, ("fire", "light", "eau", "und ", "the "))
    places = "with f as (" + " union all ".join(f"select source as book, doc_id, {O.q(k)} as kind, {O.q(label)} as label, regexp_extract_all(text, {O.q(p)}) as found from documents" for k, ps in bank.items() for label, p in ps.items()) + ") "
    over_documents("pattern_places", lambda d: G.pattern_places(d, bank).withColumn("examples", F.array_join("examples", "|")), places + "select book, doc_id, kind, label, len(found)::bigint as n, array_to_string(found[1:3], '|') as examples from f where len(found) > 0")
    over_documents("pattern_usage", lambda d: G.pattern_usage(d, bank), places + "select book, kind, label, sum(len(found))::bigint as total, count(*) as chapters from f where len(found) > 0 group by book, kind, label")
    over_documents("image_usage", lambda d: G.image_usage(d, images), "select book, word, sum(n)::bigint as total from (" + " union all ".join(f"select source as book, {O.q(w)} as word, {O.literal('text', w)} as n from documents" for w in images) + ") where n > 0 group by book, word")
    n, mean, cv = O.spread("v")
    kept = f"list_filter(list_transform(regexp_extract_all(text, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$'), lambda x: {O.trim('x')}), lambda x: x <> '')"
    chapters = f"""with k as (select source as book, doc_id, text, list_transform({kept}, lambda x: length(x)) as v from documents),
c as (select book, doc_id, length(text)::bigint as chars, len(v)::bigint as sentences, coalesce({O.scaled(mean, '10')}, 0) as mean, coalesce({O.scaled(cv, '1000')}, 0) as burstiness, {', '.join(f"{O.count('text', p)}::bigint as {m}" for m, p in G.MARKS.items())} from k)
"""
    over_documents("chapter_rhythm", G.chapter_rhythm, chapters + "select * from c")
    average = lambda c, by, name: O.scaled(f"sum({c})::double / count(*) / {by}", "10") + f" as {name}"
    over_documents(
        "book_rhythm",
        G.book_rhythm,
        chapters + f"select book, count(*) as chapters, sum(chars)::bigint as chars, {', '.join(average(m, '1.0::double', m) for m in G.MARKS)}, {average('burstiness', '1000.0::double', 'burstiness')}, {average('mean', '10.0::double', 'mean_length')}, min(burstiness) < 350 as warning from c group by book",
    )
    letters = "[^一-鿿]" if P is ZH else "[^A-Za-z]"
    over_documents(
        "bigrams_topk",
        lambda d: Y.top_ngrams(d, 2, 20, 1, letters),
        f"""with t as (select doc_id, regexp_replace(text, {O.q(letters)}, '', 'g') as t from documents),
g as (select doc_id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) as gram, unnest(range(1, length(t))) as i from t where length(t) >= 2),
k as (select doc_id, gram, count(*) as n, min(i) as first from g group by doc_id, gram)
select doc_id, gram, n, row_number() over (partition by doc_id order by n desc, first) as rank from k qualify rank <= 20""",
    )
    clean = "regexp_replace(replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '#{1,6}\\s', '', 'g'), '**', ''), '\\s', '', 'g')"
    over_documents("too_short", G.too_short, f"select doc_id, 'too-short' as type, 'advisory' as severity, length({clean})::bigint as n from documents where length({clean}) < 100")
