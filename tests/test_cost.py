"""What a row's work must not do: walk a text again for each hit, run a pattern twice, or hold a whole batch as Python objects."""

import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions.packs import LATIN
from lectern.operators import anchors as A
from lectern.operators import detectors as D
from lectern.operators import matching as M
from lectern.operators import reviews as V
from lectern.operators import rewriting as W
from lectern.operators import rules as U
from lectern.operators import scores as X
from lectern.operators import structure as S
from lectern.operators.scan import Scan


def seconds(df):
    began = time.time()
    n = df.count()
    return time.time() - began, n


def test_hits_do_not_walk_the_text_again(spark):
    """a text of n hits is read once, so four times the hits take far less than sixteen times as long."""
    text = lambda n: spark.createDataFrame([(1, "ab é ### cd\n" * n)], "doc_id long, text string")
    for find in (lambda d: A.narrated(d, LATIN.grades), lambda d: D.slang_hits(d, LATIN)):
        seconds(find(text(100)).select(*find(text(1)).columns))
        plan = find(text(5))._jdf.queryExecution().optimizedPlan().toString()
        assert "substring(text" not in plan
        assert seconds(find(text(30000)))[1] == 30000
    row = A.narrated(text(2), LATIN.grades).orderBy("pos").collect()[1]
    assert (row.term, row.pos, row.quoted) == ("###", 18, False)
    hit = D.slang_hits(text(9), LATIN).orderBy("pos").collect()[5]
    assert hit.before == ("ab é ### cd\n" * 9)[hit.pos - 31 : hit.pos + 29] and len(hit.before) == 60


def test_located_reads_a_line_once(spark):
    """F12, F16, F21: one pass over a line serves all lists; the longest term of each list at a place, lists on their own."""
    docs = spark.createDataFrame([(1, "x und with and\nicense 'und' con"), (2, None)], "doc_id long, text string")
    found = V.located(docs, LATIN)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.line_no, r.col, r.type, r.excerpt) for r in found.collect())
    assert got == [
        (1, 3, "emotion-direct", "x und with and"), (1, 7, "ai-connector", "x und with and"), (1, 7, "narrative-ban-b", "x und with and"), (1, 12, "ai-connector", "with and"),
        (2, 1, "cliched-appearance", "icense con"), (2, 9, "emotion-direct", "ense con"),
    ]


def test_few_rows_are_objects_at_once():
    """a function over a batch takes some rows at a time."""
    seen = []
    of = M.sliced(lambda a: seen.append(len(a)) or pa.array([[x] for x in a.to_pylist()], pa.list_(pa.int64())))
    assert of(pa.array(range(1000))).to_pylist() == [[x] for x in range(1000)] and max(seen) <= M.SLICE
    assert of(pa.array([], pa.int64())).to_pylist() == []
    assert "sliced" in W.dictionary_tokens.__code__.co_names or "once" in W.dictionary_tokens.__code__.co_names


def test_tokens_stay_inside_a_function(spark):
    """densities and the poorest window cut a text inside one function, as the expressions did."""
    texts = [None, "", "a b " * 30, "la go x \" " * 200, "word one, two! " * 400 + "de la is " * 300, "ab " * 600]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tokens = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+|[一-鿿]"), F.lit(0))
    rows = docs.select(S.poorest_window("text").alias("new"), S.windows_ttr(tokens).alias("old")).collect()
    assert [r.new for r in rows[1:]] == [r.old for r in rows[1:]] and rows[0].new is None
    words = ("good", "der")
    busy = lambda s: len(re.findall('"', s)) + sum(w in LATIN.verbs for w in re.findall("[A-Za-z0-9]+", s))
    want = [[busy(s) / n for k in range(len(t) // 500) if (s := t[k * 500 : k * 500 + 500]) and (n := len(re.findall("[A-Za-z]", s)))] if len(re.findall("[A-Za-z,.!?]", t)) >= 500 else [] for t in (x or "" for x in texts)]
    assert [r.d for r in docs.select(X.densities(F.col("text"), LATIN, words).alias("d")).collect()] == want and any(want)
    for found in (X.objective_scores(docs, LATIN, words), Scan(LATIN, words).findings(docs), U.rule_states(docs, Scan(LATIN, words), [(r, True) for r in U.ALL])):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "[A-Za-z0-9]+|" not in plan
