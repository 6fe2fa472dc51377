"""Scanners and rewrites of punctuation: tables of values, and laws over drawn texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import rewriting as W


def each(spark, build, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r.o for r in rows.select("i", build(F.col("s")).alias("o")).orderBy("i").collect()]


CONTRASTS = {
    "不是风，而是人。": ["不是风，而是人"],
    "他不是不知道，是不敢说——真的。后来": ["不是不知道，是不敢说——真的"],
    "不是甲是乙": ["不是甲是乙"],
    "是不是，而是": [],
    "莫不是他而是我": [],
    "岂不是他，而是我": [],
    "不是他就是我": [],
    "不是他就是我，而是她": ["不是他就是我，而是她"],
    "不是甲。是乙": ["不是甲。是乙"],
    "不是甲。而是乙": [],
    "不是甲.而是乙": ["不是甲.而是乙"],
    "不是甲，是吗": [],
    "不是甲，乙是丙": [],
    "不是甲\n而是乙": [],
    "不是甲， \n 而是乙": ["不是甲， \n 而是乙"],
    "不是甲，\n\n而是乙": [],
    "不是甲！ 是乙": ["不是甲！ 是乙"],
    "不是是": [],
    "不是" + "x" * 50 + "而是y": ["不是" + "x" * 50 + "而是y"],
    "不是" + "x" * 51 + "而是y": [],
    "不是" + "x" * 49 + "，而是y": ["不是" + "x" * 49 + "，而是y"],
    "不是" + "x，" * 25 + "而是y": ["不是" + "x，" * 25 + "而是y"],
    "不是" + "x，" * 25 + "z而是y": [],
    "不是a而是" + "z" * 100: ["不是a而是" + "z" * 80],
    "不是a而是b） ": ["不是a而是b"],
    "不是甲不是乙，而是丙。不是丁而是戊": ["不是甲不是乙，而是丙", "不是丁而是戊"],
}


def test_contrasts(spark):
    texts = list(CONTRASTS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in W.contrast_findings(docs).collect():
        got[r.doc_id].append(r.passage)
    assert {texts[i]: x for i, x in got.items()} == CONTRASTS


def test_contrast_places(spark):
    docs = spark.createDataFrame([(1, "a\n“不是甲，而是乙”\n不是丙，而是丁"), (2, '"x" 不是甲，而是乙 "不是丙，而是丁"'), (3, None)], "doc_id int, text string")
    got = sorted((r.doc_id, r.line_no, r.severity) for r in W.contrast_findings(docs).collect())
    assert got == [(1, 2, "advisory"), (1, 3, "blocking"), (2, 1, "blocking")]


def test_contrasts_of_long_texts(spark):
    """Nothing in the expression is tried in two ways: long texts without a lift end soon, and do not overflow the stack."""
    docs = spark.createDataFrame([(1, "不是" * 20000), (2, "不是" + "x，" * 50000), (3, "就是" * 30000 + "不是" + "就是" * 30000)], "doc_id int, text string")
    assert W.contrast_findings(docs).count() == 0


PAUSES = {
    "": "", "没有": "没有", "他……走": "他，走", "他说。……": "他说。", "……他": "他", "  ——他": "  他", "3—5": "3到5", "3 -- 5天": "3 到 5天",
    "他—”": "他。”", "他……": "他。", "他……  ": "他。  ", "他……，走": "他，走", "原因——太晚": "原因：太晚", "走了——因为": "走了：因为", "走 …… 问题在于": "走 ： 问题在于",
    "「……他": "「他", "（——他": "（他", "他…… ……走": "他 走", "他-走": "他-走", "a..b": "a..b", "a....b": "a，b", "他……\n……她": "他。\n她", "他……\n\n3—\n4": "他。\n\n3。\n4",
}


def test_pauses(spark):
    got = each(spark, W.rewrite_pauses, list(PAUSES))
    assert {s: o.text for s, o in zip(PAUSES, got, strict=True)} == PAUSES
    assert [o.n for o in got] == [len(re.findall(W.PAUSE, s)) for s in PAUSES]


CORNERS = {
    '"a"': "「a」", "“a”": "「a」", "“a“b”c”": "「a「b」c」", '"a，"b"': "「a，「b」", "”": "」", 'x"\n"y': "x「\n「y", 'x"y\nz"': "x「y\nz」", "「a」": "「a」", "": "",
}


def test_corner_quotes(spark):
    assert dict(zip(CORNERS, each(spark, W.corner_quotes, list(CORNERS)), strict=True)) == CORNERS


NORMAL = {
    "a\n---\nb": ("a\nb", 1), "a\n ---\t\n---\nb": ("a\nb", 2), "a\n---": ("a", 1), "---": ("", 1), "a\r\n---\r\nb……": ("a\r\nb。", 2), "----": ("", 1),
    "```\n---\na……\n```\nb……c": ("```\n---\na……\n```\nb，c", 1), "```\nopen……": ("```\nopen……", 0), "x……\n  ```py\n……\n```\n……y": ("x。\n  ```py\n……\n```\ny", 2),
    "---\ntitle: a……b\n---\nc……d": ("---\ntitle: a……b\n---\nc，d", 1), "---\nno key\n---\nc": ("no key\nc", 2), "a\n": ("a\n", 0), "\n": ("\n", 0),
}


def test_normalize(spark):
    got = each(spark, W.normalize, list(NORMAL))
    assert {s: (o.text, o.n) for s, o in zip(NORMAL, got, strict=True)} == NORMAL
    assert [tuple(o) for o in each(spark, lambda c: W.normalize(c, "corner"), ['"a"\n---\n```\n"b"\n```', None])] == [('「a」\n```\n"b"\n```', 3), (None, 0)]
    assert [tuple(o) for o in each(spark, lambda c: W.normalize(c, "ascii"), ["「a」“b……”"])] == [('"a""b。"', 5)]


@pytest.mark.parametrize("quotes", ["keep", "ascii", "corner"])
def test_normal_texts_stay(spark, quotes):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["他", "走", "，", "。", "……", "—", "\n", " ", "\"", "“", "”", "3", "---", "```\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    once = [o.text for o in each(spark, lambda c: W.normalize(c, quotes), texts)]
    fenced = lambda s: "```" in s
    for s, t in zip(texts, once, strict=True):
        if not fenced(s):
            assert not any(x in t for x in ("…", "—", "...")) and "\n---\n" not in f"\n{t}\n"
    twice = [o.n for s, o in zip(once, each(spark, lambda c: W.normalize(c, "keep"), once), strict=True) if not fenced(s)]
    assert not any(twice)
