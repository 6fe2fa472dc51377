"""The detectors with the Chinese pack on a drawn Chinese corpus, against their SQL on the same tables."""

import random
import re

import compare
import pytest

from lectern.functions.packs import ZH
from lectern.plans import queries as plans

FOUND, SQL = plans.register(ZH)
#: RE2 has no lookahead, or the SQL names the Latin kinds only, or the tables are others than documents.
OTHERS = {"placeholder_leaks", "number_mentions", "value_limits", "age_mismatch", "distance_mismatch"}
#: What the corpus must hold, so that a comparison of no rows can't pass for a proof.
FILLED = {
    "long_paragraph", "dash_count", "connector_hits", "emotion_direct", "banned_terms", "banned_terms_b", "transition_pattern", "vague_time", "cliche_terms", "breathy_tags", "simile_density", "imagery_repeat",
    "burstiness", "ttr_low", "short_sentence_runs", "dialogue_streak", "transition_stacking", "prefix_triples", "adjacent_repeat", "repeated_sentences", "truncated_docs", "meta_leaks", "emotion_density", "slang_density",
    "genre_conflict", "slang_staleness", "reward_gap", "emotion_flat", "missing_hook", "sentence_variance", "opener_duplicates", "objective_score", "route", "located_findings", "findings_report", "write_gate", "rule_results", "rule_telemetry", "rule_states", "execution_rates", "pattern_places", "pattern_usage", "image_usage", "chapter_rhythm", "book_rhythm", "tokens_fmm", "lexicon_hits",
}
TAKES_DOCUMENTS = sorted(k for k in SQL if k not in OTHERS and "documents" in SQL[k] and not re.search(r"\b(events|labels|conversations|orders|pages|customer|supplier)\b", SQL[k]))


def corpus() -> list[tuple]:
    """Chapters of three books: plain ones, and for each limit some under and over it."""
    rng = random.Random(11)
    words = [w for ws in ZH.lists.values() for w in ws] + [w for ws in ZH.categories.values() for w in ws] + list(ZH.excludes) + [w for ws in ZH.senses.values() for w in ws] + list(ZH.sense_excludes) + list(ZH.verbs)
    plain = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    run = lambda a, b: "".join(rng.choice(plain) for _ in range(rng.randint(a, b)))
    same = f"{run(14, 14)}。"

    def line() -> str:
        kind = rng.randrange(12)
        if kind == 0:
            return f"“{run(2, 9)}。”"
        if kind == 1:
            return f"{rng.choice(ZH.lists['starts'])}，{run(3, 12)}。"
        if kind == 2:
            return f"他像{run(2, 6)}一样{run(2, 5)}，仿佛{run(3, 8)}。"
        if kind == 3:
            return "".join(f"{run(1, 4)}。" for _ in range(rng.randint(2, 8)))
        if kind == 4:
            return f"{run(2, 5)}——{run(2, 5)}……{run(1, 3)}{rng.choice('。！？')}"
        if kind == 5:
            return f"没有{run(3, 6)}，不是{run(3, 6)}，不是{run(2, 5)}而是{run(2, 4)}。"
        if kind == 6:
            return f"{run(4, 4)}{run(2, 6)}。" * rng.randint(1, 3)
        if kind == 7:
            return same * rng.randint(1, 3)
        out = "".join(rng.choice(words) if rng.random() < 0.4 else run(2, 6) for _ in range(rng.randint(2, 9)))
        return out + rng.choice(["。", "！", "？", "，", "……", ""])

    def text(i: int) -> str:
        n = rng.choice([0, 1, 3, 8, 20, 60])
        lines = [line() for _ in range(n)]
        if i % 5 == 0:
            lines += [f"“{run(1, 4)}。”"] * rng.choice([5, 6, 8])
        if i % 5 == 1:
            lines += [run(198, 203) + "。"]
        if i % 5 == 2:
            term = rng.choice(ZH.lists["imagery"])
            lines += [f"{run(2, 3)}{term}。" for _ in range(rng.choice([2, 3, 5]))] + [rng.choice(["# 题", "> 引", "---", "", "   "])]
        if i % 5 == 3:
            lines = [f"{run(9, 11)}。" for _ in range(rng.choice([7, 8, 12]))]
        if i % 7 == 0:
            lines += [rng.choice(list(ZH.grades["S"])) + run(1, 3)] * rng.choice([3, 4])
        if i % 7 == 1:
            lines += [rng.choice(ZH.grades[g]) + run(1, 3) for g in "ABC"]
        if i % 7 == 2:
            lines += [run(2, 4) + rng.choice(ZH.lists[k]) + run(1, 3) + "。" for k in ("ban_b", "breathy") for _ in range(rng.choice([2, 3, 4]))]
        if i % 9 == 0:
            lines = ["开篇相同的十个字在这里"] + lines
        if i % 11 == 0:
            lines += [(run(2, 3) + "。") * 300]
        return rng.choice(["\n", "\n", "\r\n"]).join(lines)

    genres = list(ZH.genres)
    return [(i, text(i), genres[i % len(genres)], f"book{0 if i < 70 else 1 + i % 2}", 0) for i in range(130)] + [(201, "", None, "book2", 0), (202, "　　全角空白。　", "都市", "book2", 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("golden"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{at}/parts")
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(f"{at}/parts"), f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", TAKES_DOCUMENTS)
def test_chinese_rules_equal_their_sql(spark, folder, name):
    compare.same(FOUND[name](spark, folder), SQL[name], folder)
    if name in FILLED:
        assert not FOUND[name](spark, folder).isEmpty()


def test_all_that_should_hold_rows_is_compared():
    assert FILLED <= set(TAKES_DOCUMENTS)
