"""Readers, writers and small column functions, by round trips and values."""

import json

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import detectors as D
from lectern.sources import files as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_texts_and_ranges(spark, tmp_path):
    for name, text in (("第2章.md", "﻿---\nk: v\n---\n正文"), ("sub/ch10.txt", "b\r\nc"), ("x.json", "{}")):
        at = tmp_path / "t" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    rows = X.read_texts(spark, f"{tmp_path}/t")
    assert sorted((r.chapter_no, r.text) for r in rows.collect()) == [(2, "---\nk: v\n---\n正文"), (10, "b\r\nc")]
    assert X.newest(rows).first().path.endswith((".md", ".txt"))
    assert sorted(r[0] for r in X.chapter_range(spark, "1-3, 7,x, 9-8,2-4").collect()) == [1, 2, 3, 4, 7]


def test_configurations(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"id": "R1", "enabled": True, "threshold": 3, "severity": "blocking", "more": 1}]}))
    (tmp_path / "bad.json").write_text("{")
    got = X.read_config(spark, f"{tmp_path}/*.json", "rules").where("rules is not null")
    assert [tuple(r.rules[0]) for r in got.collect()] == [("R1", True, 3.0, "blocking")]
    j = F.lit('{"a": {"b": [{"c": 1}, {"c": 2}]}}')
    assert [one(spark, X.json_at(j, p)) for p in (".a.b[1].c", ".a.b[].c", ".a.b | length", ".x")] == ["2", "[1,2]", "2", None]


def test_tables_sections_and_tags(spark):
    docs = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |\ntext\n| 3 | 4 |")], "doc_id int, text string")
    assert sorted((r.line_no, list(r.cells)) for r in X.markdown_table(docs).collect()) == [(3, ["1", "2"]), (5, ["3", "4"])]
    assert [one(spark, X.section(F.lit(t), "目标")) for t in ("# x\n## 目标\nabc\n## y", "**目标**：abc\n**z**", "【目标】abc\n【u】", "none")] == ["abc", "abc", "abc", None]
    assert one(spark, X.tagged_body(F.lit("a<chapter_content>b\nc</chapter_content>d"))) == "b\nc" and one(spark, X.tagged_body(F.lit("abc"))) == "abc"


def test_writers(spark, tmp_path):
    state = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    X.write_state(state, f"{tmp_path}/dry")
    assert not (tmp_path / "dry").exists()
    for _ in range(2):
        X.write_state(state, f"{tmp_path}/s", write=True)
        X.append_snapshot(state, f"{tmp_path}/log", "end", "2024-01-02 03:04:05")
    assert sorted((r.id, r.v) for r in spark.read.schema("id int, v string").json(f"{tmp_path}/s/json").collect()) == [(1, "x"), (2, None)]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/s/markdown").collect()) == ["| 1 | x |", "| 2 | - |"]
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 4 and {r.label for r in log.collect()} == {"end"}
    X.write_index(spark.createDataFrame([("k", "place", 1)], "keyword string, kind string, doc_id int"), f"{tmp_path}/index")
    assert (tmp_path / "index" / "kind=place").exists()


def test_manifest_and_candidates(spark):
    old = spark.createDataFrame([("a", "1", 40, 2), ("b", "2", None, None)], "id string, sha256 string, total int, blocking int")
    new = spark.createDataFrame([("b", "3", 50, 0), ("c", "4", 1, 1)], "id string, sha256 string, total int, blocking int")
    assert sorted(map(tuple, X.updated_manifest(old, new).collect())) == [("a", "1", 40, 2), ("b", "3", 50, 0)]
    chapters = spark.createDataFrame([(1,), (2,), (3,)], "chapter int")
    found = spark.createDataFrame([(1, 2, "p2", 20.0), (1, 1, "p1", 10.0), (2, 4, "q", None)], "chapter int, priority int, path string, score double")
    assert sorted(map(tuple, X.first_existing(chapters, found).collect())) == [(1, "p1", 10.0), (2, "q", None), (3, None, None)]


def test_blocks(spark):
    text = "a\n<!-- s:start -->\nold\n<!-- s:end -->\nb"
    assert one(spark, X.replace_block(F.lit(text), "s", "new")) == "a\n<!-- s:start -->\nnew\n<!-- s:end -->\nb"
    assert one(spark, X.replace_block(F.lit("a"), "s", "new")) == "a\n<!-- s:start -->\nnew\n<!-- s:end -->"


def test_small_functions(spark):
    assert [one(spark, T.numeral_prefix(F.lit(x))) for x in ("三十岁", "二万x五", "x三")] == [30.0, 20000.0, 0.0]
    assert one(spark, T.said(F.lit('“甲”乙「丙」"丁"『』'))) == ["甲", "丙", "丁"]
    assert one(spark, T.plain_sentences(F.lit("甲…乙\n丙。 ！丁"))) == ["甲…乙\n丙", "丁"]
    assert one(spark, T.without_markdown(F.lit("## a **b**\n```\nc\n```\nd"))) == "a b\n\nd"
    array = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert [one(spark, D.set_distance(a, b)) for a, b in ((array("x", "y"), array("y", "z")), (array(), array()), (array("x"), array()))] == [1 - 1 / 3, 0.0, 1.0]
    rows = spark.createDataFrame([("a", i) for i in range(30)], "k string, i int")
    assert [(r.n, r["first"]) for r in D.samples(rows, "k", order="i", k=3).collect()] == [(30, [0, 1, 2])]


def test_entities(spark):
    docs = spark.createDataFrame([(1, "王小明说道。去天云城，伏笔在此。忽然说。他走到了青石桥。")], "doc_id int, text string")
    got = sorted((r.pos, r.keyword, r.kind) for r in D.entities(docs, stop=("忽然",), prefixes="了的他去", known=("他人",)).collect())
    assert (1, "王小明", "character") in got and (12, "伏笔", "foreshadow") in got and not any(k.startswith(("去", "他")) or k == "忽然" for _, k, _ in got)


def test_files_that_are_no_texts_are_rejected(spark, tmp_path):
    from lectern.operators.reconcile import exit_codes
    from lectern.sources.files import read_checked_texts

    for name, data in {"1.md": "\ufeff一".encode(), "sub/2.txt": b"", "3.md": b"\xff\xfe broken", "4.md": b"x" * 50, "5.pdf": b"\xff"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    texts, rejects = read_checked_texts(spark, f"file://{tmp_path}", most=40)
    assert sorted((r.chapter_no, r.text) for r in texts.collect()) == [(1, "一")]
    assert sorted((r.path[-4:], r.reason, r.length) for r in rejects.collect()) == [("3.md", "not UTF-8", 9), ("4.md", "too long", 50)]
    files = texts.selectExpr("chapter_no as doc_id")
    found = spark.createDataFrame([(1, "advisory")], "doc_id long, severity string")
    codes = lambda **how: sorted(tuple(r) for r in exit_codes(files, found, rejects.selectExpr("3L as doc_id"), **how).collect())
    assert codes() == [(1, 1), (3, 2)] and codes(fail_on="blocking") == [(1, 0), (3, 2)]
