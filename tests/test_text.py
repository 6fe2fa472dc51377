"""Column functions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.packs import ZH
from lectern.operators import rewriting


def each(spark, build, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in rows.select("i", build("s").alias("o")).orderBy("i").select("o").collect()]


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(3)
    return ["".join(rng.choice("ab他是。！？…\n　 \"“”1#-") for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_sentences(spark, samples):
    want = [[x for x in (re.sub(r"^[\s　 ﻿]+|[\s　 ﻿]+$", "", p) for p in re.split(ZH.ends, s)) if x] for s in samples]
    assert each(spark, lambda c: T.sentences(c, ZH.ends), samples) == want


def test_char_ngrams(spark, samples):
    assert each(spark, lambda c: T.char_ngrams(c, 3), samples) == [[s[i : i + 3] for i in range(len(s) - 2)] for s in samples]


def test_counts(spark, samples):
    assert each(spark, lambda c: T.count_terms(c, ("aa", "a", "他是")), samples) == [s.count("aa") + s.count("a") + s.count("他是") for s in samples]
    assert each(spark, lambda c: T.count_literal(c, "a"), [None, ""]) == [0, 0]


def test_thirds_and_segments(spark, samples):
    assert ["".join(x) for x in each(spark, T.thirds, samples)] == samples
    assert each(spark, lambda c: T.segments(c, 7), samples) == [[s[i : i + 7] for i in range(0, len(s) - 6, 7)] for s in samples]


def test_numerals(spark):
    """Section marks multiply all that stands before them, as in 三万五千."""
    assert each(spark, T.numeral, ["二十三", "十五", "一百零三", "三万五千", "半", "12.5", "两亿"]) == [23.0, 15.0, 103.0, 35000.0, 0.5, 12.5, 2e8]


def test_cosine(spark):
    df = spark.sql("select array(3.0D, 4.0D) a, array(3.0D, 4.0D) b, array(0.0D, 0.0D) z")
    assert [round(x, 12) for x in df.select(T.cosine(F.col("a"), F.col("b")), T.cosine(F.col("a"), F.col("z"))).first()] == [1.0, 0.0]


def test_normalizing_keeps_plain_texts(spark):
    docs = spark.createDataFrame([(1, "没有什么要改。"), (2, "")], "doc_id long, text string")
    out = rewriting.normalized(docs)
    assert out.count() == 2
