"""The automaton against slow searches, and the scan of all findings as one pass."""

import random
import re
from collections import Counter

from lectern.functions.packs import ZH
from lectern.operators.matching import Lexicon, each_of, longest_of
from lectern.operators.scan import Scan


def drawn(seed):
    rng = random.Random(seed)
    terms = tuple(dict.fromkeys("".join(rng.choice("ab漢𝒳") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 9))))
    return terms, "".join(rng.choice("ab漢𝒳c") for _ in range(rng.randint(0, 40)))


def test_automaton_equals_slow_searches():
    for seed in range(400):
        terms, text = drawn(seed)
        want = sorted((i, m.start()) for i, t in enumerate(terms) for m in re.finditer(re.escape(t), text))
        assert sorted(each_of(terms, text)) == want
        pattern = "|".join(map(re.escape, sorted(terms, key=lambda w: -len(w)))) or "(?!)"
        assert [(terms[i], at) for i, at in longest_of(terms, text)] == [(m.group(), m.start()) for m in re.finditer(pattern, text)]


def test_columns(spark):
    lexicon = Lexicon({"x": ("aa", "a", "a"), "y": ("ab", "a"), "none": ()})
    docs = spark.createDataFrame([(1, "aaab"), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.doc_id: list(r.n) for r in docs.select("doc_id", lexicon.counts("text").alias("n")).collect()} == {1: [7, 4, 0], 2: [0, 0, 0], 3: [0, 0, 0]}
    assert Counter(map(tuple, lexicon.hits(docs, "doc_id", longest=True).collect())) == Counter([(1, "x", "aa", 1), (1, "y", "ab", 3)])
    assert lexicon.hits(docs, "doc_id").where("list = 'y'").count() == 4
    assert Lexicon({}).hits(docs.withColumn("list", docs["doc_id"]), "doc_id").count() == 0


def test_all_findings_read_texts_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = Scan(ZH, ()).findings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_findings_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n"), (None, "漢" * 5000)], "doc_id long, text string").selectExpr("*", "1 as _prose", "2 as n")
    assert {r.doc_id for r in Scan(ZH, ()).findings(docs).collect()} <= {None}
