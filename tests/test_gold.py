"""Scanners and numbers: rows expected of small texts, and queries that read whole tables."""

import re

import pytest

from lectern.operators import consistency as C
from lectern.operators import rewriting as W
from lectern.operators import rhythm as H
from lectern.plans import queries as plans

GOLD = [
    (1, "他今年二十三岁，走了三里路。\n不是风，而是人。\n“快跑！”张三说。"),
    (2, "三百岁的长老想起当年……独自一人斩杀了敌人。\n他不是不知道，是不敢说——真的。"),
    (3, "```\n不是甲，而是乙\n```\n张三丰十五岁，张三二十岁。\n---\n结尾"),
    (4, ""),
]
LATIN = [(5, "He is 300 years old, not here but there.\n20000 men, 12 km"), (6, 'und the token = "x"')]


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame(GOLD, "doc_id long, text string")


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or df.columns)).collect())


def test_gold(gold):
    assert rows(W.contrast_findings(gold)) == [(1, 2, "blocking", "不是风，而是人"), (2, 2, "blocking", "不是不知道，是不敢说——真的"), (3, 2, "blocking", "不是甲，而是乙")]
    assert rows(W.normalized(gold)) == [
        (1, GOLD[0][1], 0),
        (2, "三百岁的长老想起当年，独自一人斩杀了敌人。\n他不是不知道，是不敢说，真的。", 2),
        (3, "```\n不是甲，而是乙\n```\n张三丰十五岁，张三二十岁。\n结尾", 1),
        (4, "", 0),
    ]
    assert rows(C.mentions(gold), "doc_id", "kind", "pos", "value", "unit") == [(1, "age", 4, 23.0, ""), (1, "distance", 11, 3.0, "里"), (2, "age", 1, 300.0, ""), (3, "age", 20, 15.0, ""), (3, "age", 25, 20.0, "")]
    assert rows(C.value_limits(C.mentions(gold))) == [(2, "age", 1, "blocking")]
    assert rows(C.exact_names(gold, ["张三", "张三丰"])) == [(1, "张三", 1), (3, "张三", 1), (3, "张三丰", 1)]
    assert rows(H.speakers(gold, ["张三", "李四"])) == [(1, 3, "快跑！", "张三")]
    assert rows(C.lone_kills(gold)) == [(2,)]


def test_queries_over_texts_of_a_folder(spark, gold, tmp_path):
    """Chinese and Latin rules of the registered queries, on tables that hold both."""
    docs = gold.unionByName(spark.createDataFrame(LATIN, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(8, 2, '"Go!" token said.')], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def got(name, *names):
        return rows(plans.QUERIES[name](spark, str(tmp_path)), *names)

    assert [r[0] for r in got("contrast_scan")] == [1, 2, 3, 5] and got("contrast_scan")[3] == (5, 1, "blocking", "not here but there")
    assert [r[0] for r in got("normalize_punctuation")] == [1, 2, 3, 4, 5, 6]
    assert got("number_mentions", "doc_id", "kind", "value", "unit")[-3:] == [(5, "age", 300.0, ""), (5, "count", 20000.0, ""), (5, "distance", 12.0, "km")]
    assert got("value_limits", "doc_id", "kind", "severity") == [(2, "age", "blocking"), (5, "age", "blocking"), (5, "count", "advisory")]
    assert got("exact_name_match") == [(1, "张三", 1), (3, "张三", 1), (3, "张三丰", 1)]
    assert got("speaker_attribution") == [("1", 3, "快跑！", "张三"), ("6", 1, "x", "token"), ("8:2", 1, "Go!", "token")]
    assert got("lone_kills") == [(2,), (6,)]
    assert [x for x in got("numeral_values") if x[0] in (1, 5)] == [(1, "三", 3.0, 2), (1, "二十三", 23.0, 1), (5, "12", 12.0, 1), (5, "20000", 20000.0, 1), (5, "300", 300.0, 1)]


def test_queries_read_whole_tables(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id for r in plans.QUERIES["normalize_punctuation"](spark, sf).collect()} == set(texts)
    units = {"years", "year", "ans", "años", "Jahre", "Jahren", "km", "m", "mi"}
    found = plans.QUERIES["number_mentions"](spark, sf).where("kind = 'count'").groupBy("doc_id").count().collect()
    want = {i: sum(w not in units for w in re.findall("[0-9]+ ([^\\W\\d_]+)", t)) for i, t in texts.items()}
    assert {r.doc_id: r["count"] for r in found} == {i: n for i, n in want.items() if n} != {}
    values = plans.QUERIES["numeral_values"](spark, sf).groupBy("doc_id").sum("n").collect()
    want = {i: len(re.findall("[0-9]+(?:[.][0-9]+)?", t)) for i, t in texts.items()}
    assert {r.doc_id: r["sum(n)"] for r in values} == {i: n for i, n in want.items() if n} != {}
