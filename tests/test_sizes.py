"""Queries on texts and tables of a size or wording that the test tables lack."""

import compare
import pytest

from lectern.functions.packs import LATIN
from lectern.plans import queries as plans

FOUND, SQL = plans.register(LATIN)


@pytest.fixture
def folder(spark, tmp_path):
    """A folder with ``documents`` of the given texts."""

    def of(*texts: str) -> str:
        import pyarrow.parquet as pq

        rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/parts")
        pq.write_table(pq.read_table(f"{tmp_path}/parts"), f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return of


@pytest.mark.parametrize("name", ["chapter_rhythm", "book_rhythm"])
def test_sentences_whose_squares_fit_no_int(spark, folder, name):
    at = folder("a" * 50_000 + ". Short.", "b " * 70_000, "One. Two words. Three words here.", "")
    compare.same(FOUND[name](spark, at), SQL[name], at)


@pytest.mark.parametrize("name", ["number_mentions", "value_limits"])
def test_units_before_letters_of_other_scripts(spark, folder, name):
    """The SQL's words are ASCII ones: a unit ends before a letter that isn't."""
    at = folder("call 5551641 miñmi now", "4000 mé, 300 ansé, 90000 m2, 5 km_ 12000 kmé", "250 ans. 7000 mi", "none", "3 m 160 years")
    compare.same(FOUND[name](spark, at), SQL[name], at)
    assert not FOUND[name](spark, at).isEmpty()


def test_characters_of_a_class_are_counted_as_matches(spark):
    """Runs, surrogate pairs, blanks at the ends and nulls, against the engine's own count and its trim by a pattern."""
    from pyspark.sql import functions as F

    from lectern.functions import text as T

    texts = [None, "", " 　 a　b ﻿\n\x0b\f\r\t", "\U00020000\U00020001x，y.", "“a” 12 [b]！" * 3, " a ", "\x1c a \x1c", " a"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in ("[\\p{L}\\p{N}]", "[A-Za-z]|[,.!?]", "[一-鿿]|[“”！？。，]", "[^a]", "[？?]"):
        got = rows.select(T.count_matches("text", p).alias("n"), F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias("m"))
        assert all(r.n == r.m for r in got.collect()), p
        plan = got.select("n")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "regexp_count" not in plan  # an array of all characters
    ends = rows.select(T.jtrim("text").alias("t"), F.regexp_replace("text", rf"^{T.BLANK}|{T.BLANK}\z", "").alias("u"))
    assert all(r.t == r.u for r in ends.collect())


def test_openings_meet_by_classes(spark, folder):
    """Equal openings in several blocks, overlaps of two to ten n-grams, wide characters; no pair of all chapters is shuffled to be counted."""
    from lectern.operators import rhythm as H

    texts = ["abcdefghijklmnop", "zabcdefghijklmnop", "zzzzzzzzzzzzzzzz", "abcdefg!", "abcdef?", "abcde", "abc", "", "天地玄黄宇宙洪荒", "\U00020000\U00020001天地玄黄宇宙洪", "efghijQQQQQQ", "xyabcdexxabcdefxx"] * 4
    at = folder(*texts)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    compare.same(FOUND["opener_duplicates"](spark, at), SQL["opener_duplicates"], at)
    compare.same(H.opener_duplicates(docs, LATIN, block=3), SQL["opener_duplicates"], at)
    own = H.opener_duplicates(docs, LATIN)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" not in own
