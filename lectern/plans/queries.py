"""The registered queries of the analytics part, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packs import LATIN, ZH, Pack
from ..operators import consistency as C
from ..operators import deltas as E
from ..operators import detectors as D
from ..operators import reconcile as R
from ..operators import reviews as V
from ..operators import rewriting as W
from ..operators import rhythm as H
from ..operators import scores as X
from ..operators import structure as S
from ..operators import triggers as G
from ..operators.matching import Lexicon
from ..operators.scan import Scan
from . import oracle as O
from . import practice, story

Queries = dict[str, Callable[[SparkSession, str], DataFrame]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(x.strip() for x in ctes) + "\n"


def register(P: Pack) -> tuple[Queries, dict[str, str]]:
    """The queries with the lists of a pack, and the SQL of those that SQL can express."""
    L = P.lists
    #: Words that hold a verb of the Latin pack, for the maximum matching of the scores.
    WORDS = ("good", "der", "des", "lado", "isch")
    SCAN = Scan(P, WORDS)
    found: Queries = {}
    stated: dict[str, str] = {}

    def over_documents(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        found[name] = lambda spark, sf_dir: build(table(spark, sf_dir, "documents"))
        if sql:
            stated[name] = sql


    def over_tables(name: str, build: Callable, sql: str | None = None) -> None:
        """``build`` takes a function from a table's name to its DataFrame."""
        found[name] = lambda spark, sf_dir: build(lambda t: table(spark, sf_dir, t))
        if sql:
            stated[name] = sql


    # structuring
    over_documents(
        "doc_lines",
        lambda d: S.prose_lines(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("blank").alias("n_blank"), F.count_if("structural").alias("n_structural"), F.sum(F.length("line")).cast("long").alias("chars")),
        with_(O.lines(P)) + "select doc_id, count(*) as n_lines, count(*) filter (where blank) as n_blank, count(*) filter (where structural) as n_structural, sum(length(line))::bigint as chars from p group by doc_id",
    )
    over_documents(
        "prose_lines",
        lambda d: S.narrative_lines(d, P).select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("line_md5"), "visible"),
        with_(O.lines(P)) + "select doc_id, line_no, md5(line) as line_md5, visible from nl",
    )
    over_documents(
        "line_classes",
        lambda d: S.prose_lines(d).where("not blank").groupBy("doc_id").agg(F.count_if(F.col("line").rlike("[“”‘’「」『』\"]")).alias("dialogue"), F.count_if(~F.col("line").rlike("[“”‘’「」『』\"]") & T.contains_any("line", L["imagery"])).alias("description"), F.count_if(~F.col("line").rlike("[“”‘’「」『』\"]") & ~T.contains_any("line", L["imagery"])).alias("narrative")),
        with_(O.lines(P)) + f"""select doc_id, count(*) filter (where said) as dialogue, count(*) filter (where not said and seen) as description, count(*) filter (where not said and not seen) as narrative
    from (select doc_id, regexp_matches(line, '[“”‘’「」『』"]') as said, {O.any_of('line', L['imagery'])} as seen from p where not blank) group by doc_id""",
    )
    over_documents(
        "visible_length",
        lambda d: d.select("doc_id", T.visible_length("text", P.visible).alias("visible"), T.visible_length("text", ZH.visible).alias("visible_narrow")),
        f"select doc_id, {O.count('text', P.visible)}::bigint as visible, {O.count('text', ZH.visible)}::bigint as visible_narrow from documents",
    )
    over_documents(
        "sentence_stats",
        lambda d: S.sentence_rows(d, P).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("visible").alias("total"), F.max("visible").alias("longest")),
        with_(O.sentences(P)) + "select doc_id, count(*) as n, sum(visible)::bigint as total, max(visible) as longest from s group by doc_id",
    )
    over_documents(
        "dialogue_spans",
        lambda d: d.select("doc_id", F.regexp_extract_all("text", F.lit('"([^"]*)"'), F.lit(1)).alias("_s")).where(F.size("_s") > 0).select("doc_id", F.size("_s").cast("long").alias("spans"), F.length(F.array_join("_s", "")).cast("long").alias("chars")),
        "select doc_id, len(s)::bigint as spans, length(array_to_string(s, ''))::bigint as chars from (select doc_id, regexp_extract_all(text, '\"([^\"]*)\"', 1) as s from documents) where len(s) > 0",
    )
    over_documents(
        "doc_thirds",
        lambda d: d.select("doc_id", T.thirds("text").alias("_t")).select("doc_id", *[T.count_terms(F.element_at("_t", i), L["plot"]).alias(f"third_{i}") for i in (1, 2, 3)]),
        "with t as (select doc_id, text, length(text) // 3 as n from documents) select doc_id, " + ", ".join(f"{O.terms(x, L['plot'])}::bigint as third_{i}" for i, x in enumerate(("substr(text, 1, n)", "substr(text, n + 1, n)", "substr(text, 2 * n + 1)"), 1)) + " from t",
    )
    over_documents(
        "context_snippets",
        lambda d: d.where(F.contains("text", F.lit("icense"))).select("doc_id", F.locate("icense", F.col("text")).alias("_p"), "text").select("doc_id", T.line_of("text", F.col("_p")).alias("line_no"), T.compact(T.snippet("text", F.col("_p"), 30)).alias("snippet")),
        "with h as (select doc_id, text, strpos(text, 'icense') as p from documents where contains(text, 'icense')) select doc_id, 1 + length(substr(text, 1, p - 1)) - length(replace(substr(text, 1, p - 1), chr(10), '')) as line_no, trim(regexp_replace(substr(text, greatest(p - 30, 1), p + 30 - greatest(p - 30, 1)), '\\s+', ' ', 'g'), ' ') as snippet from h",
    )

    # tokens and matching
    #: Words of two to four characters for maximum matching; a full dictionary is a parameter.
    DICTIONARY = sorted({w for ws in ZH.lists.values() for w in ws if 2 <= len(w) <= 4})
    over_documents(
        "tokens_fmm",
        lambda d: W.dictionary_tokens(d, DICTIONARY).select("doc_id", F.size("tokens").cast("long").alias("tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("kinds")),
        f"select doc_id, len(t)::bigint as tokens, len(list_distinct(t))::bigint as kinds from (select doc_id, regexp_extract_all(text, {O.q(W.dictionary_pattern(DICTIONARY))}) as t from documents)",
    )
    over_documents(
        "ttr_windows",
        lambda d: d.select("doc_id", T.scaled(S.windows_ttr(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+|[一-鿿]"), F.lit(0)))).alias("ttr")),
        "with t as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]') as t from documents) select doc_id, " + O.scaled("case when len(t) < 50 then 0 when len(t) < 500 then len(list_distinct(t))::double / len(t) else list_min(list_transform(range(0, len(t) // 500), lambda i: len(list_distinct(t[i * 500 + 1 : i * 500 + 500]))::double / 500)) end") + " as ttr from t",
    )
    over_documents(
        "lexicon_hits",
        lambda d: D.list_counts(d, Lexicon(L)),
        " union all ".join(f"select doc_id, {O.q(k)} as list, {O.terms('text', ws)}::bigint as n from documents where {O.terms('text', ws)} > 0" for k, ws in L.items()),
    )
    over_documents(
        "fmm_exclude_hits",
        lambda d: d.select("doc_id", F.explode(D.category_hits("text", P)).alias("category")).groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n")),
        f"select doc_id, category, count(*) as n from (select doc_id, unnest({O.hits('text', P)}) as category from documents) group by doc_id, category",
    )
    over_documents(
        "char_ngrams_topk",
        H.top_ngrams,
        """with t as (select doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') as t from documents),
    g as (select doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) as gram, unnest(range(1, length(t) - 1)) as i from t where length(t) >= 3),
    k as (select doc_id, gram, count(*) as n, min(i) as first from g group by doc_id, gram having count(*) >= 3),
    r as (select *, row_number() over (partition by doc_id order by n desc, first) as rank from k)
    select doc_id, gram, n, rank from r where rank <= 50""",
    )
    over_documents("punctuation_census", H.punctuation, "select doc_id, " + ", ".join(f"{O.count('text', p)}::bigint as {k}" for k, p in {"commas": "[,，]", "stops": "[.。]", "questions": "[?？]", "shouts": "[!！]", "colons": "[:：]", "semicolons": "[;；]", "dashes": "——|—|--+", "ellipses": "…+|\\.{3,}"}.items()) + " from documents")
    PATTERNS = {"token": 'token = "[0-9a-z]+', "number": "[0-9]{4,}", "shout": "[A-Z]{3,}!+", "junk": "[#*$%&]{3}", "pipe": " \\| "}
    over_documents(
        "pattern_bank_counts",
        lambda d: H.used_patterns(d, PATTERNS),
        "select book, label, sum(n)::bigint as total, count(*) as chapters from (" + " union all ".join(f"select source as book, {O.q(k)} as label, {O.count('text', p)} as n from documents" for k, p in PATTERNS.items()) + ") where n > 0 group by book, label",
    )

    # detectors
    over_documents("long_paragraph", lambda d: D.long_paragraphs(d, P), with_(O.lines(P)) + "select doc_id, line_no, length(line)::bigint as n from nl where length(line) > 200")
    over_documents("dash_count", lambda d: SCAN.findings(d, "dash_count"), with_(O.lines(P), f"d as (select doc_id, sum({O.count('line', '——|—|--+')}) as c from p group by doc_id)") + O.finding("d", "em-dash", "c", 5, 8))
    over_documents("connector_hits", lambda d: SCAN.findings(d, "connector_hits"), with_(O.lines(P)) + O.finding("nt", "ai-connector", O.count("narrative", "(?:" + "|".join(L["connectors"]) + ")[,，。！？!?.]"), 1, None))
    for _name, _kind, _list, _a, _b, _whole in (
        ("emotion_direct", "emotion-direct", "emotion_direct", 1, None, False),
        ("banned_terms", "narrative-ban-a", "ban_a", None, 1, False),
        ("banned_terms_b", "narrative-ban-b", "ban_b", 3, None, False),
        ("transition_pattern", "transition-pattern", "transitions", 5, None, False),
        ("vague_time", "vague-time-jump", "vague_time", 2, None, True),
        ("cliche_terms", "cliched-appearance", "cliches", 1, None, True),
        ("breathy_tags", "breathy-dialogue-tags", "breathy", 4, None, True),
    ):
        over_documents(
            _name,
            lambda d, k=_name: SCAN.findings(d, k),
            O.finding("documents", _kind, O.terms("text", L[_list]), _a, _b) if _whole else with_(O.lines(P)) + O.finding("nt", _kind, O.terms("narrative", L[_list]), _a, _b),
        )
    over_documents(
        "simile_density",
        lambda d: SCAN.findings(d, "simile_density"),
        with_(O.lines(P), f"d as (select doc_id, ({' + '.join(O.count('narrative', p) for p in P.similes)}) * 1000.0::double / {O.count('narrative', P.visible)} as x from nt where {O.count('narrative', P.visible)} >= 200)")
        + f"select doc_id, 'metaphor-density' as type, case when x > 4 then 'blocking' else 'advisory' end as severity, {O.scaled('x')} as n from d where x > 3",
    )
    over_documents("imagery_repeat", lambda d: D.repeated_images(d, P), with_(O.lines(P)) + f"select doc_id, term, case when count(*) >= 5 then 'blocking' else 'advisory' end as severity, count(*) as n from nl join (select unnest([{', '.join(O.q(t) for t in L['imagery'])}]) as term) on contains(narrative, term) group by doc_id, term having count(*) >= 3")
    _TERMS = " union all ".join(f"select unnest([{', '.join(O.q(t) for t in dict.fromkeys(ts))}]) as term, '{k}' as kind" for k, ts in (("image", L["imagery"]), ("reaction", P.reactions)))
    over_documents("worn_images", lambda d: SCAN.repeats(d), with_(O.lines(P)) + f"select doc_id, kind, term, min(line_no) as line_no, case when count(*) >= 5 then 'blocking' else 'advisory' end as severity, count(*) as n from nl join ({_TERMS}) on contains(narrative, term) where visible > 0 group by all having count(*) >= 3")
    _n, _mean, _cv = O.spread("v")
    NARRATED = with_(O.lines(P), f"ss as (select doc_id, list(n) filter (where n > 0) as v from (select doc_id, len(regexp_extract_all(unnest({O.sents('narrative', P)}), {O.q(P.visible)})) as n from nl) group by doc_id)")
    over_documents(
        "burstiness",
        lambda d: SCAN.findings(d, "burstiness"),
        NARRATED + f"select doc_id, 'burstiness' as type, case when cv < 0.35 then 'blocking' else 'advisory' end as severity, {O.scaled('cv')} as n from (select doc_id, {_cv} as cv from ss where len(v) >= 8) where cv < 0.5",
    )
    over_documents("ttr_low", lambda d: SCAN.findings(d, "ttr_low"), "with t as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]') as t from documents where length(text) >= 200), r as (select doc_id, case when len(t) < 50 then 0 when len(t) < 500 then len(list_distinct(t))::double / len(t) else list_min(list_transform(range(0, len(t) // 500), lambda i: len(list_distinct(t[i * 500 + 1 : i * 500 + 500]))::double / 500)) end as x from t) " + f"select doc_id, 'ttr-low' as type, 'advisory' as severity, {O.scaled('x')} as n from r where x < 0.25")
    over_documents("short_sentence_runs", lambda d: D.short_sentence_runs(d, P), with_(O.sentences(P), "v as (select * from s where visible > 0)") + O.runs("v", "visible <= 5", 6, "doc_id", "sentence_no"))
    over_documents("dialogue_streak", lambda d: D.dialogue_streaks(d, P), with_(O.lines(P), "g as (" + O.runs("p", f"regexp_matches(line, '[“”‘’「」『』\"]') and {O.count(O.strip('line'), P.visible)} <= 10", 6, "doc_id", "line_no") + ")") + "select *, case when n >= 8 then 'blocking' else 'advisory' end as severity from g")
    over_documents("transition_stacking", lambda d: SCAN.findings(d, "transition_stacking"), with_(O.lines(P), "d as (select doc_id, count(*) filter (where " + " or ".join(f"starts_with(line, {O.q(t)})" for t in L["starts"]) + ") as c from p0 where line <> '' group by doc_id)") + O.finding("d", "transition-stacking", "c", 3, None))
    over_documents(
        "prefix_triples",
        lambda d: SCAN.findings(d, "prefix_triples"),
        with_(
            O.sentences(P),
            "t as (select doc_id, sentence as a, lead(sentence, 1) over (partition by doc_id order by sentence_no) as b, lead(sentence, 2) over (partition by doc_id order by sentence_no) as c from s)",
            "u as (select *, least(4, length(a), length(b), length(c)) as k from t where c is not null)",
            "d as (select doc_id, count(*) as c from u where k >= 2 and substr(a, 1, k) = substr(b, 1, k) and substr(a, 1, k) = substr(c, 1, k) group by doc_id)",
        )
        + O.finding("d", "parallelism-abuse", "c", None, 1),
    )
    over_documents(
        "adjacent_repeat",
        lambda d: D.adjacent_repeats(d, P),
        with_(O.lines(P), "w as (select *, lag(line) over (partition by doc_id order by line_no) as b from p where not blank and line not like '#%' and line not like '---%')") + f"select doc_id, line_no from w where line = b and {O.count(O.strip('line'), P.visible)} >= 8",
    )
    over_documents("repeated_sentences", lambda d: D.repeated_sentences(d, P), with_(O.sentences(P)) + "select doc_id, count(*) as n, min(sentence_no) as first_at from s where visible >= 12 group by doc_id, sentence having count(*) >= 3")
    over_documents("truncated_docs", lambda d: D.truncated(d, P), with_(O.lines(P), "w as (select doc_id, max(line_no) as line_no, arg_max(line, line_no) as line from p where not blank and line not like '#%' and line not like '---%' group by doc_id)") + f"select doc_id, line_no from w where not regexp_matches(line, {O.re2(P.closing + '$')})")
    over_documents("placeholder_leaks", lambda d: D.placeholders(d, P), with_(O.lines(P)) + "select doc_id, line_no, pattern::bigint as pattern from (select doc_id, line_no, case " + " ".join(f"when regexp_matches(line, {O.q(x)})" + (" and not regexp_matches(line, '[\"''「」『』【】]')" if i in P.soft else "") + f" then {i}" for i, x in enumerate(P.placeholders, 1)) + " end as pattern from p) where pattern is not null")
    over_documents(
        "meta_leaks",
        lambda d: D.meta_leaks(d, P),
        with_(O.lines(P), f"w as (select *, row_number() over (partition by doc_id order by line_no) = 1 and regexp_matches(line, {O.re2(P.title)}) as title, {O.any_of('line', L['meta_1'])} as one from p where not blank)")
        + f"select * from (select doc_id, line_no, case when one and not regexp_matches(line, '[\"''「」『』【】]') then 'blocking' when one or regexp_matches(line, {O.re2(P.meta_2)}) then 'advisory' end as severity from w where not title) where severity is not null",
    )
    over_documents("contrast_counts", lambda d: SCAN.findings(d, "contrast_counts"), O.finding("documents", "parallelism-abuse", O.count("text", P.blocking[0]), 2, None))
    over_documents(
        "emotion_density",
        lambda d: D.emotion_profile(d, P),
        f"with h as (select doc_id, {O.hits('text', P)} as h, length(regexp_replace(text, '\\s', '', 'g')) as n from documents) select doc_id, len(h)::bigint as hits, len(list_distinct(h))::bigint as kinds, n::bigint as chars, {O.scaled('len(h) * 1000.0::double / nullif(n, 0)')} as density from h",
    )
    over_documents(
        "emotion_variety",
        lambda d: SCAN.findings(d, "emotion_variety"),
        f"with h as (select doc_id, {O.hits('text', P)} as h, length(regexp_replace(text, '\\s', '', 'g')) as n from documents), e as (select doc_id, len(list_distinct(h)) as kinds, {O.scaled('len(h) * 1000.0::double / nullif(n, 0)')} as density from h where n > 0) select * from (select doc_id, 'emotion-density' as type, case when density < 3000000 then 'advisory' when density > 15000000 then 'blocking' end as severity, density as n from e union all select doc_id, 'emotion-variety', case when kinds < 3 then 'advisory' end, kinds::bigint from e) where severity is not null",
    )
    _SET = lambda i: f"list_sort(list_distinct(h{i}))"
    over_documents(
        "emotion_curve",
        lambda d: D.emotion_curve(d, P),
        "with t as (select doc_id, text, length(text) // 3 as k from documents), c as (select doc_id, substr(text, 1, k) as t1, substr(text, k + 1, k) as t2, substr(text, 2 * k + 1) as t3 from t), h as (select doc_id, "
        + ", ".join(f"{O.hits(f't{i}', P)} as h{i}" for i in (1, 2, 3))
        + f" from c) select * from (select doc_id, case when len(h1) = 0 or len(h3) = 0 then 'empty-end' when {_SET(1)} = {_SET(2)} and {_SET(2)} = {_SET(3)} then 'flat' end as type from h) where type is not null",
    )
    _WORDS = V.alternation([*(w for ws in P.categories.values() for w in ws), *P.excludes])
    over_documents(
        "emotion_monotony",
        lambda d: D.monotone_words(d, P),
        f"select doc_id, term, case when count(*) >= 8 then 'blocking' else 'advisory' end as severity, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, {O.q(_WORDS)})) as term from documents) where term not in ({', '.join(O.q(x) for x in P.excludes)}) group by doc_id, term having count(*) >= 5",
    )
    over_documents("slang_density", lambda d: SCAN.findings(d, "slang_density"), O.finding("documents", "slang-density", " + ".join(O.terms("text", t) for t in P.grades.values()), 4, None))
    _SLANG = "g as (" + " union all ".join(f"select doc_id, text, {O.q(w)} as term, x.pos as pos from (select doc_id, text, unnest({O.spans('text', re.escape(w))}) as x from documents where contains(text, {O.q(w)}))" for ws in P.grades.values() for w in ws) + ")"
    over_documents(
        "slang_clustering",
        lambda d: D.slang_clusters(d, P),
        f"with {_SLANG}, w as (select doc_id, pos - lag(pos) over (partition by doc_id order by pos, term) as gap from g) select doc_id, count(*) as n from w where gap < 100 group by doc_id",
    )
    over_documents(
        "role_mismatch",
        lambda d: D.role_mismatches(d, P),
        f"with {_SLANG} select doc_id, term, pos from g where {O.any_of('substr(text, greatest(pos - 30, 1), pos + 30 - greatest(pos - 30, 1))', L['roles'])}",
    )
    over_documents(
        "genre_conflict",
        lambda d: D.genre_conflicts(d, P, "lang"),
        " union all ".join(f"select doc_id, {O.q(g)} as grade, {O.terms('text', t)}::bigint as n from documents where {O.terms('text', t)} > 0 and coalesce(lang, '') not in ({', '.join([O.q(x) for x, ok in P.genres.items() if g in ok] or ['null'])})" if any(g in ok for ok in P.genres.values()) else f"select doc_id, {O.q(g)} as grade, {O.terms('text', t)}::bigint as n from documents where {O.terms('text', t)} > 0" for g, t in P.grades.items()),
    )
    over_documents("slang_staleness", lambda d: D.stale_slang(d, P), f"select book, n from (select source as book, count(*) as chapters, sum({' + '.join(O.terms('text', P.grades[g]) for g in ('B', 'C'))})::bigint as n from documents group by source) where chapters > 50 and n > 0")
    over_documents(
        "info_density",
        lambda d: SCAN.findings(d, "info_density"),
        f"with d as (select doc_id, {O.densities('text', P, WORDS)} as d from documents where length(text) >= 1000), m as (select doc_id, d, list_sum(d) / len(d) as m from d where len(d) >= 3), v as (select doc_id, list_sum(list_transform(d, lambda x: (x - m) * (x - m))) / len(d) as v from m) select doc_id, 'info-density-uniform' as type, 'advisory' as severity, {O.scaled('v')} as n from v where v < 0.002",
    )
    _NO = "(?:没有|不是|并非)"
    _PAIR, _LIFT = _NO + "[^，。；！？\n]{2,30}[，]" + _NO + "[^，。；！？\n]{2,30}[，]", _NO + "[^，。；！？\n]{2,60}[，].*?(?:而是|只有|那是一种|那是|只剩|唯有)"
    over_documents(
        "negation_parallel",
        lambda d: SCAN.findings(d, "negation_parallel"),
        with_(O.lines(P), f"d as (select doc_id, sum(case when a > 0 then a else least(b, 1) end) as c from (select doc_id, {O.count('narrative', _PAIR)} as a, {O.count('narrative', _LIFT)} as b from nl where visible > 0) group by doc_id)") + O.finding("d", "negation-parallelism", "c", None, 1),
    )

    # across chapters
    over_documents("reward_gap", lambda d: H.reward_gaps(d, P), with_(O.CHAPTERS, "g as (" + O.runs("c", f"not {O.any_of('text', L['reward'])}", 3, "book", "chapter_no") + ")") + "select book, start, n, case when n >= 5 then 'blocking' else 'advisory' end as severity from g")
    over_documents("emotion_flat", lambda d: H.flat_emotion(d, P), with_(O.CHAPTERS) + O.runs("c", f"not {O.any_of('text', L['feeling'])}", 3, "book", "chapter_no"))
    over_documents(
        "ratio_imbalance",
        lambda d: H.ratio_imbalance(d, P),
        f"select * from (select source as book, sum({O.terms('text', L['foreshadow'])})::bigint as hits, sum({' + '.join(O.terms('text', L[k]) for k in ('plot', 'character', 'foreshadow'))})::bigint as total from documents group by source) where total >= 5 and (hits * 5 > total or hits * 20 < total)",
    )
    over_documents("missing_hook", lambda d: H.missing_hooks(d, P), with_(O.CHAPTERS) + f"select book, chapter_no from c where not {O.any_of('right(text, 500)', L['hooks'])}")
    over_documents("sentence_variance", lambda d: H.sentence_variance(d, P), with_(O.CHAPTERS, f"v as (select book, chapter_no, {O.lengths('text', P)} as v from c)", f"r as (select book, chapter_no, {_cv} * {_mean} as x from v where len(v) >= 10)") + f"select book, chapter_no, {O.scaled('x', '1e3')} as deviation from r where x < 8")
    over_documents(
        "rhythm_collapse",
        lambda d: H.rhythm_collapse(d, P),
        with_(
            O.CHAPTERS,
            f"v as (select book, chapter_no, {O.lengths('text', P)} as v from c)",
            f"m as (select book, chapter_no, coalesce({_mean}, 0) as mean from v)",
            "w as (select book, chapter_no, sum(mean) over a as x, sum(mean) over b as y, count(*) over a as n, count(*) over b as m from m window a as (partition by book order by chapter_no rows between 3 preceding and 1 preceding), b as (partition by book order by chapter_no rows between current row and 2 following))",
            "hit as (select book, chapter_no from w where n = 3 and m = 3 and x > 0 and y < x * (1 - 0.3::double))",
            "g as (select book, min(chapter_no) as chapter_no from hit group by book union all select g.book, min(h.chapter_no) from g join hit h on h.book = g.book and h.chapter_no >= g.chapter_no + 3 group by g.book)",
        ).replace("with ", "with recursive ", 1)
        + "select book, chapter_no from g",
    )
    over_documents(
        "opener_duplicates",
        lambda d: H.opener_duplicates(d, P),
        with_(
            O.CHAPTERS,
            "o as (select book, chapter_no, substr(text, 1, 200) as t from c)",
            "g as (select distinct book, chapter_no, gram from (select book, chapter_no, unnest(list_transform(range(1, least(10, length(t) - 3) + 1), lambda i: substr(t, i, 4))) as gram from o where length(t) >= 4))",
        )
        + "select x.book as book, x.chapter_no as a, y.chapter_no as b, count(*) as shared, case when count(*) >= 5 then 'blocking' else 'advisory' end as severity from g x join g y on x.book = y.book and x.gram = y.gram and x.chapter_no < y.chapter_no group by x.book, x.chapter_no, y.chapter_no having count(*) >= 3",
    )
    over_documents(
        "cross_doc_ngrams",
        H.shared_ngrams,
        """with t as (select doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') as t from documents),
    g as (select doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) as gram, unnest(range(1, length(t) - 1)) as i from t where length(t) >= 3),
    k as (select doc_id, gram, count(*) as n, min(i) as first from g group by doc_id, gram having count(*) >= 3),
    r as (select *, row_number() over (partition by doc_id order by n desc, first) as rank from k)
    select gram, count(*) as docs, sum(n)::bigint as n from r where rank <= 50 group by gram having count(*) >= 2 order by docs desc, n desc, gram limit 20""",
    )
    _PART = lambda a, b: O.scaled(f"coalesce(({a})::double / nullif({b}, 0), 0)")
    _STYLE = with_(
        O.CHAPTERS,
        f"v as (select book, chapter_no, text, {O.lengths('text', P)} as v, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: {O.trim('x')}), lambda x: x <> '') as l from c)",
        f"""f as (select book, chapter_no, {O.scaled(f'coalesce({_cv}, 0)')} as variation, {_PART("len(list_filter(l, lambda x: regexp_matches(x, '[“”‘’「」『』\"]')))", "len(l)")} as dialogue,
  {_PART(O.count('text', '[,，]'), O.count('text', P.visible))} as commas, {_PART(O.count('text', '[.。]'), O.count('text', P.visible))} as stops from v)""",
    )
    over_documents("style_fingerprint", lambda d: H.style_fingerprint(d, P), _STYLE + "select * from f")
    _FAR = " + ".join(f"{w}::double * coalesce(abs({c} - lag({c}) over b)::double / nullif(greatest({c}, lag({c}) over b), 0), 0)" for c, w in (("variation", 0.3), ("dialogue", 0.25), ("commas", 0.25), ("stops", 0.2)))
    over_documents("style_drift", lambda d: H.style_drift(d, P), _STYLE + f"select book, chapter_no, distance from (select book, chapter_no, {O.scaled('0.0::double + ' + _FAR)} as distance, row_number() over b as r from f window b as (partition by book order by chapter_no)) where r > 1 and distance > 300000")
    over_documents("volume_rollup", H.volumes, with_(O.CHAPTERS) + "select book, volume, chapters, chars, ((3 - volume % 3) % 3)::bigint as to_audit from (select book, ceil(chapter_no / 10.0)::bigint as volume, count(*) as chapters, sum(length(text))::bigint as chars from c group by all)")
    over_documents("latest_n", H.latest, with_(O.CHAPTERS) + "select book, chapter_no, doc_id from (select *, row_number() over (partition by book order by chapter_no desc) as r from c) where r <= 5")
    over_tables(
        "chapter_gaps",
        lambda t: H.chapter_gaps(t("labels").join(S.chapters(t("documents").select("source", "doc_id")), "doc_id").select("book", "chapter_no")),
        with_(O.CHAPTERS, "k as (select distinct book, chapter_no from c join labels using (doc_id))", "w as (select book, chapter_no, lag(chapter_no) over (partition by book order by chapter_no) as after from k)") + "select book, after, chapter_no as before from w where chapter_no - after > 1",
    )

    # voices
    _LONG = lambda f: f"sum(len(list_filter(v, lambda x: {f})))"
    _RATIO = lambda a, b: f"coalesce({a}::double / nullif({b}, 0), 0)"
    _VOICE = [_RATIO("kinds", "tokens"), f"least({_RATIO('length', 'sentences')} / 50, 1)", f"least({_RATIO('particles', 'chars')} * 100 / 10, 1)", *(_RATIO(k, "sentences") for k in ("short", "middle", "large")), _RATIO("asks", "n"), _RATIO("shouts", "n")]
    VOICES = f"""with r as (select conv_id, role, coalesce(text, '') as text from conversations),
e as (select conv_id, role, {O.count('text', P.visible)} as chars, {O.terms('text', L['particles'])} as particles, regexp_matches(text, '[？?]')::int as asks, regexp_matches(text, '[！!]')::int as shouts, {O.lengths('text', P)} as v, regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]') as words from r),
k as (select conv_id, role, count(distinct w) as kinds from (select conv_id, role, unnest(words) as w from e) group by conv_id, role),
s as (select conv_id, role, count(*) as n, sum(chars) as chars, sum(particles) as particles, sum(asks) as asks, sum(shouts) as shouts, sum(len(words)) as tokens, sum(len(v)) as sentences, sum(list_sum(v)) as length, {_LONG('x <= 10')} as short, {_LONG('x > 10 and x <= 25')} as middle, {_LONG('x > 25')} as large from e group by conv_id, role),
p as (select s.conv_id, s.role, case when chars > 0 then [{', '.join(_VOICE)}] else [0.0::double, 0, 0, 0, 0, 0, 0, 0] end as voice from s left join k on k.conv_id = s.conv_id and k.role = s.role)
"""
    over_tables("voice_profiles", lambda t: H.voice_profiles(t("conversations"), P, "conv_id", "role").select("conv_id", "role", *[T.scaled(F.element_at("voice", i)).alias(f"v{i}") for i in range(1, 9)]), VOICES + "select conv_id, role, " + ", ".join(f"{O.scaled(f'voice[{i}]')} as v{i}" for i in range(1, 9)) + " from p")
    _DOT = lambda a, b: f"list_sum(list_transform(range(1, 9), lambda i: {a}[i] * {b}[i]))"
    over_tables(
        "voice_similarity",
        lambda t: H.similar_voices(H.voice_profiles(t("conversations"), P, "conv_id", "role"), "conv_id", "role"),
        VOICES + f"select *, similarity > 700000 as flagged from (select x.conv_id as conv_id, x.role as a, y.role as b, {O.scaled('case when ' + _DOT('x.voice', 'x.voice') + ' = 0 or ' + _DOT('y.voice', 'y.voice') + ' = 0 then 0 else ' + _DOT('x.voice', 'y.voice') + ' / (sqrt(' + _DOT('x.voice', 'x.voice') + ') * sqrt(' + _DOT('y.voice', 'y.voice') + ')) end')} as similarity from p x join p y on x.conv_id = y.conv_id and x.role < y.role)",
    )
    over_tables(
        "turn_runs",
        lambda t: D.runs(t("conversations"), F.length("text") > 300, 1, "conv_id", order="turn"),
        O.runs("conversations", "length(text) > 300", 1, "conv_id", "turn"),
    )

    # scores and reconciliation
    SCORES = with_(O.lines(P), O.scores(P, WORDS))
    TOTAL = "plot + rhythm + texture + consistency + baseline"
    over_documents("objective_score", lambda d: X.objective_scores(d, P, WORDS), SCORES + f"select *, ({TOTAL})::bigint as total, {O.route(TOTAL)} as flow from score")
    for _part in ("plot", "rhythm", "texture", "baseline"):
        over_documents(f"{_part}_score", lambda d, k=_part: X.objective_scores(d, P, WORDS).select("doc_id", k), SCORES + f"select doc_id, {_part} from score")
    over_documents("route", lambda d: X.objective_scores(d, P, WORDS).groupBy("flow").agg(F.count(F.lit(1)).alias("n")), SCORES + f"select {O.route(TOTAL)} as flow, count(*) as n from score group by 1")
    #: Detectors whose rows are (doc_id, type, severity, n).
    DETECTORS = ("dash_count", "connector_hits", "emotion_direct", "banned_terms", "banned_terms_b", "transition_pattern", "vague_time", "cliche_terms", "breathy_tags", "simile_density", "burstiness", "ttr_low", "transition_stacking", "prefix_triples", "emotion_variety", "slang_density", "info_density", "negation_parallel", "contrast_counts")

    def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rows of all detectors, from one pass over the texts."""
        return SCAN.findings(table(spark, sf_dir, "documents"), *DETECTORS)

    _ALL = " union all ".join(f"select doc_id, type, severity, n from ({stated[k]})" for k in DETECTORS)
    found["all_findings"], stated["all_findings"] = all_findings, _ALL
    found["severity_pivot"] = lambda spark, sf_dir: R.severity_pivot(all_findings(spark, sf_dir))
    stated["severity_pivot"] = "select type, " + ", ".join(f"count(*) filter (where severity = '{x}') as {x}" for x in ("blocking", "advisory", "info")) + f" from ({_ALL}) group by type"
    found["gate"] = lambda spark, sf_dir: R.gate(all_findings(spark, sf_dir))
    stated["gate"] = f"select doc_id, (case when bool_or(severity = 'blocking') then 2 else 1 end)::bigint as code from ({_ALL}) group by doc_id"
    over_documents("exit_codes", lambda d: R.exit_codes(d, SCAN.findings(d, *DETECTORS), fail_on="blocking"), f"select d.doc_id, (case when f.doc_id is null then 0 else 1 end)::bigint as code from documents d left join (select distinct doc_id from ({_ALL}) where severity = 'blocking') f using (doc_id)")
    over_documents("doc_hashes", lambda d: d.select("doc_id", F.substring(F.md5(F.col("text").cast("binary")), 1, 8).alias("md5_8"), F.upper(F.sha2(F.col("text"), 256)).alias("sha256")), "select doc_id, substr(md5(text), 1, 8) as md5_8, upper(sha256(text)) as sha256 from documents")
    _GENRES, _CHECKS = {"de": "fr", "pt": "es"}, {"en": ("age", "power"), "fr": ("age",), "es": ("distance",)}
    over_documents("genre_checks", lambda d: X.canonical_checks(d, "lang", _GENRES, _CHECKS, "es"), "with g as (select doc_id, case when lang in ('en', 'fr', 'es') then lang when lang = 'de' then 'fr' else 'es' end as genre from documents) select doc_id, genre, case genre when 'en' then 'age,power' when 'fr' then 'age' else 'distance' end as checks from g")


    def _votes(t) -> DataFrame:
        rows = t("labels").select(F.col("doc_id").alias("key"), F.lit("prose").alias("category"), "quality", "toxic")
        agent = lambda name, c, bad: rows.select("key", "category", F.lit(name).alias("agent"), F.when(F.col(c) == bad, "advisory").otherwise("info").alias("severity"))
        return agent("reader", "quality", 0).unionByName(agent("editor", "toxic", 1))


    over_tables(
        "arbitrate_findings",
        lambda t: R.arbitrate(_votes(t)),
        """with v as (select doc_id as key, 'prose' as category, 'reader' as agent, case when quality = 0 then 'advisory' else 'info' end as severity from labels union all select doc_id, 'prose', 'editor', case when toxic = 1 then 'advisory' else 'info' end from labels),
    n as (select key, category, count(distinct agent) filter (where severity = 'blocking') as b, count(distinct agent) filter (where severity = 'advisory') as a, count(distinct agent) filter (where severity = 'info') as i from v group by key, category)
    select key, category, case when b > 0 then 'blocking' when a = 1 and i >= 3 then 'info' when a > 0 then 'advisory' else 'info' end as severity, case when b > 0 then 'blocked' when a >= 2 or i >= 3 then 'carried' else 'minority' end as ruling from n""",
    )
    over_tables(
        "composite_score",
        lambda t: R.composite(t("labels").select(F.col("doc_id").alias("key"), F.explode(F.array(F.struct(F.lit("reader").alias("source"), (F.col("quality") * 100.0).alias("score")), F.struct(F.lit("editor").alias("source"), ((1 - F.col("toxic")) * 100.0).alias("score")))).alias("x")).select("key", "x.*"), {"reader": 0.3, "editor": 0.25}),
        f"select doc_id as key, {O.scaled('(quality * 100.0::double * 0.3::double + (1 - toxic) * 100.0::double * 0.25::double) / (0.3::double + 0.25::double)')} as score from labels",
    )
    ENTITIES = {"place": ("icense", "token"), "item": ("###", "***"), "mark": ("whst", "dans")}
    over_documents(
        "keyword_index",
        lambda d: R.keyword_index(d, ENTITIES),
        " union all ".join(f"select {O.q(w)} as keyword, {O.q(k)} as kind, doc_id, {O.literal('text', w)}::bigint as n from documents where contains(text, {O.q(w)})" for k, ws in ENTITIES.items() for w in ws),
    )
    over_documents(
        "keyword_query",
        lambda d: R.query_index(R.keyword_index(d, ENTITIES), "License"),
        f"select 'icense' as keyword, 'place' as kind, doc_id, {O.literal('text', 'icense')}::bigint as n from documents where contains(text, 'icense')",
    )
    over_documents(
        "index_merge",
        lambda d: R.merge_index(R.keyword_index(d, ENTITIES), R.keyword_index(d.where("lang = 'en'"), {"mark": ("thing",)})),
        " union all ".join(f"select {O.q(w)} as keyword, {O.q(k)} as kind, doc_id, {O.literal('text', w)}::bigint as n from documents where contains(text, {O.q(w)}) and doc_id not in (select doc_id from documents where lang = 'en' and contains(text, 'thing'))" for k, ws in ENTITIES.items() for w in ws)
        + f" union all select 'thing', 'mark', doc_id, {O.literal('text', 'thing')}::bigint from documents where lang = 'en' and contains(text, 'thing')",
    )
    over_tables(
        "dead_links",
        lambda t: R.dead_links(t("pages").select(F.col("page_id").alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1)))).alias("target")), t("pages").select(F.lit("The").alias("target")).distinct(), t("pages").select(F.lit("and").alias("target")).distinct()),
        "select doc, target, case when target = 'The' then 'ok' when target = 'and' then 'archived' else 'dead' end as status from (select page_id as doc, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1))) as target from pages)",
    )
    over_tables(
        "version_sync",
        lambda t: R.versions(t("documents").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("version")), t("labels").join(t("documents"), "doc_id").select(F.col("doc_id").alias("name"), (F.col("n_chars") + F.col("toxic")).alias("version"))),
        "select d.doc_id as name, case when l.doc_id is null then 'missing' when l.toxic = 0 then 'ok' else 'mismatch' end as status from documents d left join labels l on l.doc_id = d.doc_id",
    )
    over_tables(
        "baseline_diff",
        lambda t: R.regression(t("labels").select(F.col("doc_id").alias("id"), F.lit(40).alias("total"), F.lit(0).alias("blocking")), t("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, 30).otherwise(42).alias("total"), F.col("toxic").alias("blocking"))),
        "select doc_id as id, case when quality = 0 or toxic > 0 then 'regression' else 'improvement' end as status from labels",
    )
    over_tables(
        "delta_merge",
        lambda t: R.upsert(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")), t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v")), "id"),
        "select coalesce(s.id, d.id) as id, coalesce(d.v, s.v) as v from (select c_custkey as id, c_acctbal as v from customer) s full join (select o_custkey as id, max(o_totalprice) as v from orders group by o_custkey) d on s.id = d.id",
    )


    def _deltas(t) -> DataFrame:
        """Events as deltas: a user's events in order are the chapters of a book, every seventh one out of turn."""
        from pyspark.sql import Window

        w = Window.partitionBy("user_id").orderBy("event_id")
        n = F.row_number().over(w)
        one = F.struct(F.array(F.struct(F.lit("c").alias("id"), F.lit(True).alias("alive"), F.lit(None).alias("combat_level"))).alias("character_states"), *[F.lit(None).alias(c) for c in ("number_anchors_updated", "foreshadowing_ops", "knowledge_boundary_updates", "timeline")])
        return t("events").select(F.col("user_id").cast("string").alias("book"), F.col("event_id").alias("seq"), F.when(n % 7 == 0, n + 1).otherwise(n - F.floor(n / 7)).cast("long").alias("chapter"), one.cast(E.DELTA).alias("delta"))


    over_tables(
        "delta_validate",
        lambda t: E.rulings(_deltas(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        "select case when r % 7 = 0 then 'degraded' else 'synced' end as status, count(*) as n from (select row_number() over (partition by user_id order by event_id) as r from events) group by 1",
    )
    over_tables(
        "handoff_compaction",
        lambda t: R.compacted(t("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))),
        "with f as (select user_id as key, event_type as value, min(event_id) as seq from events group by all) select e.key, e.value, k.kinds from (select user_id as key, arg_max(event_type, event_id) as value from events group by user_id) e join (select key, array_to_string(list(value order by seq), ',') as kinds from f group by key) k on k.key = e.key",
    )
    over_tables("json_paths", lambda t: t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n")), "select event_id, json_extract_string(props, '$.k') as k, length(props)::bigint as n from events")
    over_documents(
        "anchor_delivery",
        lambda d: D.anchor_delivery(d, P, d.select("doc_id", F.when(F.col("lang") == "en", "w").otherwise("icense").alias("anchor"))),
        f"with a as (select doc_id, text, {O.hits('text', P)} as h, case when lang = 'en' then 'w' else 'icense' end as anchor from documents) select doc_id, anchor, case when case when anchor in ({', '.join(O.q(k) for k in P.categories)}) then len(list_filter(h, lambda x: x = anchor)) >= 2 else contains(text, anchor) end then 'info' else 'blocking' end as severity from a",
    )

    # scanners and numbers, by the Chinese rules and by Latin ones
    NAMES = ("张三", "张三丰", "The", "There", "Der")
    SPEAKERS = ["张三", "李四", "token"]
    SPEECH = H.SPEECH + "|said|asked|dit|sagte|dijo|="
    SOLO, KILL = f"{C.SOLO[:-1]}|dans|con|und)", f"{C.KILL[:-1]}|icense|token =)"
    NUMERALS = "[零一二两三四五六七八九十百千万亿半]+|[0-9]+([.][0-9]+)?"


    def _numbers(d: DataFrame) -> DataFrame:
        return C.mentions(d, C.PATTERNS, C.LATIN_PATTERNS)


    def _spoken(t: Callable) -> DataFrame:
        """doc_id, text of documents, and of turns as conversation:turn."""
        turns = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
        return t("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(turns)


    over_documents("contrast_scan", lambda d: W.contrast_findings(d).unionByName(W.contrast_findings(d, W.LATIN_CONTRAST)))
    over_documents("normalize_punctuation", W.normalized)
    _SKIP = "'year', 'years', 'ans', 'años', 'Jahre', 'Jahren', 'km', 'm', 'mi'"
    _NUMBERS = [("age", C.LATIN_PATTERNS["age"], ""), ("distance", C.LATIN_PATTERNS["distance"], "regexp_extract(x.found, '(km|mi|m)$', 1)"), ("count", r"(\d+) (\p{L}+)", "")]
    #: The Latin kinds only: the tables hold no Chinese numbers; a count's word is tested behind the match, as the engine knows no lookahead.
    NUMBERS = "with " + ",\n".join(f"m{i} as (select doc_id, text, unnest({O.spans('text', p)}) as x from documents)" for i, (_, p, _) in enumerate(_NUMBERS)) + ",\n" + "n as (" + " union all ".join(
        f"select doc_id, '{k}' as kind, x.pos as pos, regexp_extract(x.found, '^\\d+')::double as value, {u or O.q('')} as unit, substr(text, greatest(x.pos - 50, 1), least(x.pos - 1, 50)) as before from m{i}" + (f" where regexp_extract(x.found, ' (.*)$', 1) not in ({_SKIP})" if k == "count" else "") for i, (k, _, u) in enumerate(_NUMBERS)) + ")\n"
    over_documents("number_mentions", _numbers, NUMBERS + "select * from n")
    over_documents(
        "value_limits",
        lambda d: C.value_limits(_numbers(d)),
        NUMBERS + "select * from (select doc_id, kind, pos, case " + " ".join(f"when kind = '{k}' and value > {most} then 'blocking' when kind = '{k}' and value > {warn} then 'advisory'" for k, (warn, most) in C.LIMITS.items()) + " end as severity from n) where severity is not null",
    )
    PEOPLE = [("The", 30.0), ("de", 40.0), ("token", 41.0), ("license", 50.0)]
    ROUTES = [("de", "r1", "km", 40.0), ("The", "r2", "m", 500.0)]
    over_documents(
        "age_mismatch",
        lambda d: C.age_mismatches(_numbers(d), d.sparkSession.createDataFrame(PEOPLE, "name string, age double")),
        NUMBERS + "select doc_id, name, pos, value, age from n join (values " + ", ".join(f"('{k}', {v}::double)" for k, v in PEOPLE) + ") p(name, age) on contains(before, name) where kind = 'age' and value <> age",
    )
    over_documents(
        "distance_mismatch",
        lambda d: C.distance_mismatches(_numbers(d), d.sparkSession.createDataFrame(ROUTES, "place string, route string, unit string, value double")),
        NUMBERS + "select doc_id, route, pos, value, expected from n join (values " + ", ".join(f"('{a}', '{b}', '{c}', {v}::double)" for a, b, c, v in ROUTES) + ") p(place, route, u, expected) on contains(before, place) and unit = u where kind = 'distance' and abs(value - expected) > 0.1::double * expected",
    )
    DEAD = ["The", "token"]
    MEMORY = C.FLASHBACK[1:-1]
    over_documents(
        "dead_alive",
        lambda d: C.living_dead(d, d.sparkSession.createDataFrame([(n,) for n in DEAD], "name string"), ["The", "There", "token"]),
        f"with m as (select doc_id, text, unnest({O.spans('text', 'There|token|The')}) as x from documents) select doc_id, x.found as name, x.pos as pos from m where x.found in ('The', 'token') and not regexp_matches(substr(text, greatest(x.pos - 100, 1), x.pos + 100 - greatest(x.pos - 100, 1)), '{MEMORY}')",
    )
    over_documents(
        "exact_name_match",
        lambda d: C.exact_names(d, list(NAMES)),
        "select doc_id, name, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '张三丰|There|The|Der|张三')) as name from documents) group by all",
    )
    over_tables("speaker_attribution", lambda t: H.speakers(_spoken(t), SPEAKERS, SPEECH))
    over_documents("lone_kills", lambda d: C.lone_kills(d, solo=SOLO, kill=KILL), f"select doc_id from documents where regexp_matches(text, '{SOLO}.{{0,50}}{KILL}|{KILL}.{{0,50}}{SOLO}')")
    over_documents("numeral_values", lambda d: d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(NUMERALS), F.lit(0))).alias("s")).groupBy("doc_id", "s").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "s", T.numeral("s").alias("value"), "n"))
    found["cn_number_parse"] = lambda spark, sf_dir: spark.createDataFrame([(x,) for x in ("二十三", "十五", "一百", "十万", "三万五千", "半", "12.5", "一亿两千万")], "s string").select("s", T.numeral("s").alias("value"))
    stated["cn_number_parse"] = "select * from (values ('二十三', 23.0::double), ('十五', 15.0), ('一百', 100.0), ('十万', 100000.0), ('三万五千', 35000.0), ('半', 0.5), ('12.5', 12.5), ('一亿两千万', 1000020000000.0)) t(s, value)"

    over_documents(
        "said_spans",
        lambda d: d.select("doc_id", T.said("text").alias("_s")).where(F.size("_s") > 0).select("doc_id", F.size("_s").cast("long").alias("spans"), F.md5(F.array_join("_s", "|").cast("binary")).alias("md5")),
        "select doc_id, len(s)::bigint as spans, md5(array_to_string(s, '|')) as md5 from (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[“\"][^”\"]*[”\"]|[「『][^」』]*[」』]'), lambda x: substr(x, 2, length(x) - 2)), lambda x: x <> '') as s from documents) where len(s) > 0",
    )
    over_documents(
        "plain_sentences",
        lambda d: d.select("doc_id", T.plain_sentences("text").alias("_s")).select("doc_id", F.size("_s").cast("long").alias("n"), F.size(F.array_distinct("_s")).cast("long").alias("kinds")),
        f"select doc_id, len(s)::bigint as n, len(list_distinct(s))::bigint as kinds from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?]'), lambda x: {O.trim('x')}), lambda x: x <> '') as s from documents)",
    )
    over_documents(
        "markdown_clean",
        lambda d: d.select("doc_id", F.md5(T.without_markdown("text").cast("binary")).alias("md5"), F.length(T.without_markdown("text")).cast("long").alias("chars")),
        "select doc_id, md5(t) as md5, length(t) as chars from (select doc_id, replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '(?m)^#{1,6}\\s+', '', 'g'), '**', '') as t from documents)",
    )
    _TOP = """t as (select doc_id, source, regexp_replace(text, '[^A-Za-z]', '', 'g') as t from documents),
g as (select doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) as gram, unnest(range(1, length(t) - 1)) as i from t where length(t) >= 3),
k as (select doc_id, gram, count(*) as n, min(i) as first from g group by doc_id, gram having count(*) >= 3),
r as (select *, row_number() over (partition by doc_id order by n desc, first) as rank from k), s as (select doc_id, list(gram) as grams from r where rank <= 20 group by doc_id)"""
    over_documents(
        "vocabulary_drift",
        D.vocabulary_drift,
        f"with {_TOP}, c as (select source as book, row_number() over (partition by source order by t.doc_id) as chapter_no, coalesce(grams, []) as a, coalesce(lag(grams) over (partition by source order by t.doc_id), []) as b from t left join s on s.doc_id = t.doc_id) select book, chapter_no, {O.scaled('case when len(a) + len(b) = 0 then 0 else 1 - len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end')} as distance from c where chapter_no > 1",
    )
    _NAMES = {"tagged": "([A-Z][a-z]{2,7}) (?:said|und|avec|con|with)", "upper": "([A-Z]{3,8})", "key": "(token|icense)"}
    _STOP = ("And", "The")
    over_documents(
        "entity_extraction",
        lambda d: D.entities(d, _NAMES, _STOP, "SW", ("She",)),
        "with " + ", ".join(f"e{i} as (select doc_id, unnest({O.spans('text', p)}) as x from documents)" for i, p in enumerate(_NAMES.values())) + ", e as (" + " union all ".join(f"select doc_id, regexp_extract(x.found, {O.q(p)}, 1) as keyword, {i} as i, '{k}' as kind, x.pos as pos from e{i}" for i, (k, p) in enumerate(_NAMES.items())) + ") select doc_id, keyword, arg_min(kind, i) as kind, pos from e where keyword not in ('And', 'The') and (keyword = 'She' or left(keyword, 1) not in ('S', 'W')) group by doc_id, keyword, pos",
    )

    # findings with their places, reviewers, rules, and the state of a project
    _LOCATED = " union all ".join(
        f"select doc_id, line_no, x.pos as col, {O.q(k)} as type, {O.q(s)} as severity, trim(regexp_replace(substr(narrative, greatest(x.pos - 6, 1), x.pos + 18 - greatest(x.pos - 6, 1)), '\\s+', ' ', 'g'), ' ') as excerpt from (select doc_id, line_no, narrative, unnest({O.spans('narrative', V.quoted_terms(L[n]))}) as x from nl)"
        for n, k, s in V.LOCATED
    )
    LOCATED = with_(O.lines(P), f"f as ({_LOCATED})")
    over_documents("located_findings", lambda d: V.located(d, P), LOCATED + "select * from f")
    over_documents(
        "findings_report",
        lambda d: V.reports(V.located(d, P)),
        LOCATED + "select doc_id, count(*) as n, to_json(list({'line_no': line_no, 'col': col, 'type': type, 'severity': severity} order by line_no, col, type, severity))::varchar as report, (case when bool_or(severity = 'blocking') then 2 else 1 end)::bigint as code from f group by doc_id",
    )
    over_documents(
        "write_gate",
        lambda d: V.write_gate(d, V.located(d, P), P),
        LOCATED + f"select d.doc_id, coalesce(blocking, 0) as blocking, coalesce(advisory, 0) as advisory, {O.count('text', P.visible)} < 3500 as short from documents d left join (select doc_id, count(*) filter (where severity = 'blocking') as blocking, count(*) filter (where severity = 'advisory') as advisory from f group by doc_id) t using (doc_id)",
    )


    def _reviews(t) -> DataFrame:
        """Events as findings: a user is the key, a kind of event the category, a tenth of the value the line."""
        severity = F.when(F.col("value") > 150, "blocking").when(F.col("value") > 50, "advisory").otherwise("info")
        return t("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("category"), F.floor(F.col("value") / 10).cast("long").alias("line"), severity.alias("severity"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("source"))


    over_tables(
        "merged_reviews",
        lambda t: V.merged(_reviews(t), R.RANK),
        """with r as (select user_id as key, event_type as category, floor(value / 10)::bigint as line, case when value > 150 then 3 when value > 50 then 2 else 1 end as r, 's' || (event_id % 3) as source from events),
    m as (select key, category, line, max(r) as r, array_to_string(list_sort(list_distinct(list(source))), '+') as sources, count(*) as n from r group by key, category, line)
    select key, case r when 3 then 'blocking' when 2 then 'advisory' else 'info' end as severity, category, line, sources, n, row_number() over (partition by key order by r desc, category, line) as place from m""",
    )
    over_tables(
        "majority_source",
        lambda t: V.majority(t("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 5 == 0, F.concat("event_type", F.lit("+ click"))).otherwise(F.col("event_type")).alias("source")), ("click", "signup", "error")),
        """with p as (select user_id as key, event_id as ord, unnest(case when event_id % 5 = 0 then [event_type, 'click'] else [event_type] end) as source, unnest(case when event_id % 5 = 0 then [0, 1] else [0] end) as i from events),
    c as (select key, source, count(*) as n, min(ord * 2 + i) as first from p where source in ('click', 'signup', 'error') group by key, source)
    select key, arg_min(source, -n * 1000000000000 + first) as source from c group by key""",
    )
    over_tables(
        "dimension_means",
        lambda t: V.dimension_means(t("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("dim"), F.col("event_id").alias("ord"), (F.col("event_id") % 16).alias("score"), F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("reason"))),
        """with e as (select user_id as key, event_type as dim, event_id as ord, event_id % 16 as score, 'r' || (event_id % 4) as reason from events),
    r as (select key, dim, reason, min(ord) as ord from e group by key, dim, reason), t as (select key, dim, array_to_string(list(reason order by ord), ',') as reasons from r group by key, dim)
    select e.key, e.dim, floor(sum(score) * 10::double / count(*) + 0.5) / 10 as score, any_value(reasons) as reasons from e join t on e.key = t.key and e.dim = t.dim group by e.key, e.dim""",
    )
    SPANS, NEWS = "\"([^\"]*)\"", "[?]|[5-9]{3}|whst"
    over_documents(
        "dialogue_info_windows",
        lambda d: V.quiet_windows(d, SPANS, NEWS),
        with_(O.lines(P), f"w as (select doc_id, list(x order by line_no, i) as s from (select doc_id, line_no, unnest(regexp_extract_all(line, {O.q(SPANS)}, 1)) as x, generate_subscripts(regexp_extract_all(line, {O.q(SPANS)}, 1), 1) as i from p where not blank and not structural) where x <> '' group by doc_id)")
        + f"select * from (select doc_id, len(s) // 3 as windows, len(list_filter(range(0, len(s) // 3), lambda k: not list_bool_or(list_transform(s[k * 3 + 1 : k * 3 + 3], lambda x: regexp_matches(x, {O.q(NEWS)})))))::bigint as quiet from w where len(s) >= 6) where quiet > 0",
    )
    _CONNECTED = "(?:" + V.alternation(L["connectors"]) + ")[,，。！？!?.]"
    _RULES = {"dashes": O.count("text", "——|—|--+"), "connectors": O.count("text", _CONNECTED), "banned": O.terms("text", L["ban_a"]), "emotion": O.terms("text", L["emotion_direct"]), "transitions": O.terms("text", L["transitions"]), "breathy": O.terms("text", L["breathy"])}
    _CHECKED = "c as (" + " union all ".join(f"select doc_id, {O.q(k)} as rule, {_RULES[k]}::bigint as actual, {most}::bigint as threshold, {O.q(s)} as severity from documents" for k, (most, s) in V.RULES.items()) + ")"
    over_documents("rule_results", lambda d: V.checked(d, P), f"with {_CHECKED} select doc_id, rule, actual <= threshold as passed, actual, threshold, severity from c")
    OUTSIDE = {"anchors": "external", "titles": "manual", "banned": "external"}
    over_documents(
        "rule_telemetry",
        lambda d: V.pass_rates(V.checked(d, P), OUTSIDE),
        f"with {_CHECKED}, k as (select rule, count(*) filter (where actual <= threshold) as passed, count(*) filter (where actual > threshold) as failed from c group by rule) select rule, case when failed > 0 then 'failed' else 'passed' end as status, passed, failed, {O.scaled('passed::double / (passed + failed)')} as rate from k union all select * from (values ('anchors', 'external', 0, 0, null::bigint), ('titles', 'manual', 0, 0, null))",
    )
    over_tables(
        "known_ids",
        lambda t: V.known_ids(t("events").select(F.col("event_type").alias("book"), F.col("user_id").alias("id"), F.when(F.col("event_id") % 4 == 0, "plant").otherwise("harvest").alias("action")), t("customer").where("c_custkey % 3 = 0").select(F.element_at(F.array(F.lit("click"), F.lit("error")), (F.col("c_custkey") % 2 + 1).cast("int")).alias("book"), F.col("c_custkey").alias("id"))),
        """with k as (select case when c_custkey % 2 = 0 then 'click' else 'error' end as book, c_custkey as id from customer where c_custkey % 3 = 0)
    select e.event_type as book, e.user_id as id, case when e.event_type in (select book from k) and k.id is null and e.event_id % 4 <> 0 then 'unknown' else 'ok' end as status from events e left join k on k.book = e.event_type and k.id = e.user_id""",
    )
    over_tables(
        "set_unions",
        lambda t: V.set_unions(t("supplier").select(F.col("s_nationkey").alias("key"), F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string")).alias("member")), t("customer").select(F.col("c_nationkey").alias("key"), F.concat(F.lit("s"), (F.col("c_custkey") % 9).cast("string")).alias("member"))),
        "select key, array_to_string(list_sort(list_distinct(list(member))), ',') as members from (select s_nationkey as key, 's' || (s_suppkey % 7) as member from supplier union all select c_nationkey, 's' || (c_custkey % 9) from customer) group by key",
    )
    over_tables(
        "project_gaps",
        lambda t: V.project_gaps(t("documents").where("lang = 'en'").select(F.col("doc_id").alias("chapter")), t("labels").select(F.col("doc_id").alias("chapter"))),
        "select coalesce(p.doc_id, o.doc_id) as chapter, case when o.doc_id is null then 'no outline' else 'no prose' end as gap from (select doc_id from documents where lang = 'en') p full join (select distinct doc_id from labels) o on p.doc_id = o.doc_id where p.doc_id is null or o.doc_id is null",
    )
    over_tables(
        "overdue_items",
        lambda t: R.overdue(t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CLOSED").alias("status"), (F.col("o_orderkey") % 400).alias("start")), F.lit(400)),
        "select o_orderkey as id, 400 - o_orderkey % 400 as age from orders where o_orderstatus = 'O' and 400 - o_orderkey % 400 > 50",
    )
    over_documents(
        "state_proximity",
        lambda d: V.state_proximity(d, ("token", "The"), ("icense", "whst", "***")),
        f"with m as (select doc_id, text, unnest({O.spans('text', V.quoted_terms(('token', 'The')))}) as x from documents), c as (select doc_id, x.found as name, x.pos as pos, regexp_extract(substr(text, greatest(x.pos - 30, 1), x.pos + length(x.found) + 30 - greatest(x.pos - 30, 1)), {O.q('(' + V.quoted_terms(('icense', 'whst', '***')) + ')')}, 1) as state from m) select * from c where state <> ''",
    )


    def _board(t) -> DataFrame:
        """Documents as chapters with the scores and states of their labels."""
        status = F.when(F.col("toxic") == 1, "red").when(F.col("quality") == 0, "yellow").when(F.col("quality") == 1, "green")
        own = t("documents").select("source", "doc_id").join(t("labels"), "doc_id", "left").select("source", "doc_id", (F.col("quality") * 60).alias("score"), status.alias("status"))
        return S.chapters(own)


    over_tables(
        "dashboard_rollup",
        lambda t: V.dashboard(_board(t), 50),
        """with c as (select source as book, row_number() over (partition by source order by d.doc_id) as no, quality * 60 as score, case when toxic = 1 then 'red' when quality = 0 then 'yellow' when quality = 1 then 'green' end as status from documents d left join labels l on l.doc_id = d.doc_id),
    r as (select *, row_number() over (partition by book, score is null order by no desc) as r from c)
    select book, count(*) as chapters, least(floor(count(*) * 100 / 50), 100)::bigint as progress, """ + O.scaled("avg(score) filter (where score is not null and r <= 10)", "1e3") + """ as recent,
      count(*) filter (where status = 'green') as green, count(*) filter (where status = 'yellow') as yellow, count(*) filter (where status = 'red') as red from r group by book""",
    )
    TRIGGERS = [("t1", "genre", "en", None, None), ("t2", "chapters", None, 10, 60), ("t3", "tag", "web", None, None), ("t4", "always", None, None, None), ("t5", "step", "03a", None, None)]


    def _context(d: DataFrame) -> DataFrame:
        """Documents as chapters that triggers may fire for."""
        step = F.when(F.col("doc_id") % 2 == 0, "03a").otherwise("04")
        return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("genre"), step.alias("step"), F.col("doc_id").alias("chapter"), F.array("source", F.lit("all")).alias("tags"))


    over_documents(
        "trigger_matches",
        lambda d: G.triggered(d.sparkSession.createDataFrame(TRIGGERS, "trigger string, kind string, value string, lo long, hi long"), _context(d)),
        "select doc_id as id, unnest(list_filter([case when lang = 'en' then 't1' end, case when doc_id between 10 and 60 then 't2' end, case when source = 'web' then 't3' end, 't4', case when doc_id % 2 = 0 then 't5' end], lambda x: x is not null)) as trigger from documents",
    )
    over_documents(
        "trigger_cost",
        lambda d: R.context_cost(d.select(F.col("lang").alias("section"), F.col("source").alias("file"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines")), limit=200),
        "with f as (select lang as section, source as file, max(length(text) - length(replace(text, chr(10), '')) + 1) as lines from documents group by lang, source) select section, sum(lines)::bigint as lines, sum(lines)::bigint * 15 as tokens, sum(lines) > 200 as heavy from f group by section",
    )
    SCHEMA = {"type": "object", "required": ["k", "z"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80, "enum": [*range(0, 100, 2)]}, "z": {"type": "string"}}}
    over_tables(
        "schema_validate",
        lambda t: V.schema_violations(t("events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), "props")).when(F.col("event_id") % 10 == 1, F.lit('{"k": "7", "z": 1}')).otherwise(F.col("props")).alias("j")), "event_id", "j", SCHEMA),
        """with e as (select event_id, case when event_id % 10 = 1 then '{"k": "7", "z": 1}' else props end as j, event_id % 10 = 0 as bad from events),
    k as (select event_id, bad, j, json_type(j, '$.k') as tk, json_type(j, '$.z') as tz, try_cast(json_extract_string(j, '$.k') as bigint) as k from e)
    select event_id, unnest(list_filter([case when bad then '$' end, case when not bad and tk is null then '$.k' end, case when not bad and tz is null then '$.z' end, case when not bad and tk is not null and tk not in ('BIGINT', 'UBIGINT') then '$.k' end,
        case when not bad and tk in ('BIGINT', 'UBIGINT') and k % 2 <> 0 then '$.k' end, case when not bad and tk in ('BIGINT', 'UBIGINT') and k < 10 then '$.k' end, case when not bad and tk in ('BIGINT', 'UBIGINT') and k > 80 then '$.k' end, case when not bad and tz is not null and tz <> 'VARCHAR' then '$.z' end], lambda x: x is not null)) as path,
      unnest(list_filter([case when bad then 'json' end, case when not bad and tk is null then 'required' end, case when not bad and tz is null then 'required' end, case when not bad and tk is not null and tk not in ('BIGINT', 'UBIGINT') then 'type' end,
        case when not bad and tk in ('BIGINT', 'UBIGINT') and k % 2 <> 0 then 'enum' end, case when not bad and tk in ('BIGINT', 'UBIGINT') and k < 10 then 'minimum' end, case when not bad and tk in ('BIGINT', 'UBIGINT') and k > 80 then 'maximum' end, case when not bad and tz is not null and tz <> 'VARCHAR' then 'type' end], lambda x: x is not null)) as error from k""",
    )

    story.register(P, WORDS, over_documents, over_tables)
    practice.register(P, WORDS, over_documents, over_tables)
    return found, stated


QUERIES, SQL = register(LATIN)
