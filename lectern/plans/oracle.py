"""Pieces of DuckDB SQL that the oracles of the text queries share."""

from __future__ import annotations

from ..functions import text as T
from ..functions.packs import Pack


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(p: str) -> str:
    return q(p.replace(r"\z", "$"))


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{3000}}\\x{{a0}}\\x{{feff}}]+|[\\s\\x{{3000}}\\x{{a0}}\\x{{feff}}]+$', '', 'g')"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {re2(pattern)}))"


def literal(c: str, term: str) -> str:
    return f"((length({c}) - length(replace({c}, {q(term)}, ''))) // {len(term)})"


def terms(c: str, words) -> str:
    return "(" + " + ".join(literal(c, w) for w in words) + ")"


def any_of(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def strip(c: str) -> str:
    for p in T.QUOTES:
        c = f"regexp_replace({c}, {q(p)}, '', 'g')"
    return c


def sents(c: str, pack: Pack) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, {q(pack.ends)}), lambda x: {trim('x')}), lambda x: x <> '')"


def lengths(c: str, pack: Pack) -> str:
    return f"list_filter(list_transform({sents(c, pack)}, lambda x: len(regexp_extract_all(x, {q(pack.visible)}))), lambda x: x > 0)"


def scaled(x: str, by: str = "1e6") -> str:
    return f"floor(({x}) * {by} + 0.5)::bigint"


def lines(pack: Pack) -> str:
    """CTEs p (prose lines of texts without front matter and fences) and nl (those that count)."""
    return f"""
l0 as (select doc_id, source, unnest(regexp_split_to_array(text, '\\r?\\n')) as raw, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1)::bigint as line_no from documents),
p0 as (select doc_id, source, line_no, {trim('raw')} as line from l0),
p as (select *, line = '' as blank, (regexp_matches(line, {re2(T.DIVIDER)}) or regexp_matches(line, {re2(T.STRUCTURAL)})) as structural from p0),
n0 as (select *, {strip('line')} as narrative from p where not blank and not structural),
nl as (select *, {count('narrative', pack.visible)}::bigint as visible from n0),
nt as (select doc_id, array_to_string(list(narrative order by line_no), '') as narrative from nl group by doc_id)"""


def sentences(pack: Pack) -> str:
    """CTE s: the sentences of each text."""
    return f"""
s0 as (select doc_id, source, {sents('text', pack)} as a from documents),
s1 as (select doc_id, source, unnest(a) as sentence, generate_subscripts(a, 1)::bigint as sentence_no from s0),
s as (select *, {count('sentence', pack.visible)}::bigint as visible from s1)"""


def spread(c: str) -> tuple[str, str, str]:
    """(n, mean, variation) of a list of whole numbers, by the arithmetic of the engine."""
    n, s, sq = f"len({c})::double", f"list_sum({c})::double", f"list_sum(list_transform({c}, lambda x: x * x))::double"
    mean = f"({s} / nullif({n}, 0))"
    return n, mean, f"(sqrt(greatest({sq} / nullif({n}, 0) - {mean} * {mean}, 0)) / nullif({mean}, 0))"


CHAPTERS = "c as (select source as book, row_number() over (partition by source order by doc_id) as chapter_no, doc_id, lang, text from documents)"


def graded(n: str, advisory, blocking) -> str:
    parts = ([f"when {n} >= {blocking} then 'blocking'"] if blocking is not None else []) + ([f"when {n} >= {advisory} then 'advisory'"] if advisory is not None else [])
    return f"case {' '.join(parts)} end"


def finding(source: str, kind: str, n: str, advisory, blocking) -> str:
    """Rows (doc_id, type, severity, n) of ``source``."""
    return f"select doc_id, {q(kind)} as type, {graded('n', advisory, blocking)} as severity, n::bigint as n from (select doc_id, {n} as n from {source}) where {graded('n', advisory, blocking)} is not null"


def hits(c: str, pack: Pack) -> str:
    """Categories of the longest matches of a text, in order."""
    words = {w: k for k, ws in pack.categories.items() for w in ws}
    found = "|".join(sorted({*words, *pack.excludes}, key=lambda w: (-len(w), w)))
    case = " ".join(f"when x = {q(w)} then {q(k)}" for w, k in words.items())
    drop = ", ".join(q(w) for w in pack.excludes)
    return f"list_transform(list_filter(regexp_extract_all({c}, {q(found)}), lambda x: x not in ({drop})), lambda x: case {case} end)"


def runs(source: str, hit: str, least: int, by: str, order: str) -> str:
    return f"""
select {by}, min({order}) as start, count(*) as n from (
  select *, sum(case when hit then 0 else 1 end) over (partition by {by} order by {order}) as run
  from (select *, coalesce({hit}, false) as hit from {source})
) where hit group by {by}, run having count(*) >= {least}"""


def spans(c: str, pattern: str) -> str:
    """List of (found, pos from 1) of the matches of a pattern."""
    p = re2(pattern)
    before = f"regexp_split_to_array({c}, {p})"
    found = f"regexp_extract_all({c}, {p})"
    ends = lambda a, i: f"coalesce(list_sum(list_transform({a}[1:{i}], lambda y: length(y))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'found': {found}[i], 'pos': ({ends(before, 'i')} + {ends(found, 'i - 1')} + 1)::bigint}})"


def densities(c: str, pack: Pack, words) -> str:
    """List of the information densities of the whole segments of a text."""
    from ..operators.rewriting import dictionary_pattern

    verbs, part = ", ".join(q(v) for v in pack.verbs), f"substr({c}, i * 500 + 1, 500)"
    each = f"({count(part, pack.quotes)} + len(list_filter(regexp_extract_all({part}, {q(dictionary_pattern([*words, *pack.verbs]))}), lambda t: t in ({verbs}))))::double / nullif({count(part, pack.letters)}, 0)"
    return f"case when {count(c, f'{pack.letters}|{pack.marks}')} >= 500 then list_filter(list_transform(range(0, length({c}) // 500), lambda i: {each}), lambda x: x is not null) else []::double[] end"


def scores(pack: Pack, words) -> str:
    """CTEs up to ``score``: the five parts of each text's objective score; to follow ``lines``."""
    names = {w: k for k, ws in pack.senses.items() for w in ws}
    sense_words = "|".join(sorted({*names, *pack.sense_excludes}, key=lambda w: (-len(w), w)))
    kinds = " ".join(f"when x = {q(w)} then {q(k)}" for w, k in names.items() if w not in pack.sense_excludes)
    of = lambda c, patterns: "(" + " + ".join(count(c, p) for p in patterns) + ")"
    n, mean, cv = spread("v")
    return f"""
sl as (select doc_id, line_no, line, narrative, visible from nl),
sf as (select doc_id, array_to_string(list(line order by line_no), chr(10)) as full_, array_to_string(list(narrative order by line_no) filter (where visible > 0), '') as told,
  coalesce(sum({of('narrative', pack.similes)}) filter (where visible > 0), 0) as line_similes,
  coalesce(sum({of('narrative', pack.blocking)} + {terms('narrative', pack.lists['ban_a'])}) filter (where visible > 0), 0) as blocking,
  coalesce(sum({count('line', '——|—|--+')}) filter (where visible > 0), 0) as dashes from sl group by doc_id),
ss as (select doc_id, list(n) filter (where n > 0) as v from (select doc_id, len(regexp_extract_all(unnest({sents('narrative', pack)}), {q(pack.visible)})) as n from sl where visible > 0) group by doc_id),
sa as (select d.doc_id, coalesce(full_, '') as full_, coalesce(told, '') as told, coalesce(line_similes, 0) as line_similes, coalesce(blocking, 0) as blocking, coalesce(dashes, 0) as dashes, coalesce(v, []) as v from documents d left join sf using (doc_id) left join ss using (doc_id)),
sd as (select *, {count('told', pack.visible)} as chars, {of('told', pack.similes)} as similes,
  len(list_distinct(list_filter(list_transform(regexp_extract_all(told, {q(sense_words)}), lambda x: case {kinds} end), lambda x: x is not null))) as senses,
  {densities('full_', pack, words)} as dens from sa),
sm as (select *, coalesce(list_sum(dens) / nullif(len(dens), 0), 0) as m, {n} as n, {cv} as cv, {cv} * {mean} as std, similes * 1000.0::double / nullif(chars, 0) as dense, line_similes * 1000.0::double / nullif(chars, 0) as line_dense from sd),
sb as (select *, blocking + (case when dashes >= 8 then 1 else 0 end) + (case when chars > 200 and line_dense >= 4 then 1 else 0 end) as marks from sm),
score as (select doc_id,
  greatest(15 - case when m >= 0.08 then 0 when m >= 0.05 then 2 when m >= 0.03 then 5 else 8 end - least(2 * len(list_filter(dens, lambda x: x < 0.02)), 5)
    - case when len(dens) >= 3 and list_sum(list_transform(dens, lambda x: (x - m) * (x - m))) / len(dens) < 0.002 then 2 else 0 end, 0)::bigint as plot,
  (case when n < 5 then 5 else greatest(15 - case when cv >= 0.5 then 0 when cv >= 0.3 then 5 else 10 end - case when std < 8 then 3 else 0 end, 0) end)::bigint as rhythm,
  (case when chars < 200 then 7 else greatest(10 - case when senses >= 4 then 0 when senses >= 3 then 2 else 5 end - case when dense >= 4 then 5 when dense > 3 then 3 else 0 end, 0) end)::bigint as texture,
  7::bigint as consistency, (case when marks = 0 then 10 when marks <= 2 then 7 when marks <= 5 then 3 else 0 end)::bigint as baseline from sb)"""


def route(total: str) -> str:
    return f"case when {total} >= 40 then 'fast' when {total} >= 30 then 'full' else 'rewrite' end"
