"""Front matter, fences, and what contradicts what is known, against plain Python and small tables."""

import random
import re

from lectern.functions.packs import ZH
from lectern.operators import consistency as C
from lectern.operators import reviews as V
from lectern.operators import scores as X
from lectern.operators import structure as S

BLANKS = " \t\n\r\x0b\x0c　 ﻿"


def plain_prose(text: str, strict: bool = True) -> list[tuple[int, str]]:
    lines = [x.strip(BLANKS) for x in re.split(r"\r?\n", text)]
    skip = 0
    if lines[0] == "---" and "---" in lines[1:40]:
        end = lines.index("---", 1)
        if any(re.match(r"[A-Za-z_][A-Za-z0-9_-]*\s*:", x) for x in re.split(r"\r?\n", text)[1:end]):
            skip = end + 1
    out, fence = [], ""
    for no, line in enumerate(lines, 1):
        mark = (re.match(r"`{3,}|~{3,}", line) or [""])[0]
        if fence:
            if mark and mark[0] == fence[0] and (len(mark) >= len(fence) or not strict):
                fence = ""
        elif mark:
            fence = mark
        elif no > skip:
            out.append((no, line))
    return out


def test_prose_by_a_plain_reader(spark):
    rng = random.Random(9)
    some = ["a", " b ", "", "---", "```", "~~~", "````", "```py", "  ```", "key: v", "　全角　", "~~~~~", "no key", "# h"]
    texts = ["\n".join(rng.choice(some) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    texts += ["---\nkey: v\n---\na\n```\nb\n```\nc", "---\n" + "x\n" * 50 + "k: v\n---\na", "---\r\nkey: v\r\n---\r\na", "", "~~~\n```\n~~~\nb", "k: v\n---\na"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for strict in (True, False):
        got = {r.i: [tuple(x) for x in r.p] for r in docs.select("i", S.prose("text", strict).alias("p")).collect()}
        assert got == {i: plain_prose(t, strict) for i, t in enumerate(texts)}


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or df.columns)).collect())


def test_known_people_and_routes(spark):
    docs = spark.createDataFrame([(1, "张三今年三十岁，张三丰一百岁。"), (2, "从洛阳到长安，他走了三十里。"), (3, "洛阳到长安有五里，不是五米。"), (4, "回忆里的李四。" + "他" * 120 + "李四来了，李四走了。")], "doc_id int, text string")
    people = spark.createDataFrame([("张三", 20.0), ("张三丰", 100.0), ("李四", 9.0)], "name string, age double")
    found = C.mentions(docs)
    assert rows(C.age_mismatches(found, people)) == [(1, "张三", 5, 30.0, 20.0), (1, "张三", 12, 100.0, 20.0)]
    routes = spark.createDataFrame([("长安", "r", "里", 10.0), ("长安", "s", "里", 31.0), ("无", "t", "里", 1.0)], "place string, route string, unit string, value double")
    assert rows(C.distance_mismatches(found, routes)) == [(2, "r", 11, 30.0, 10.0), (3, "r", 7, 5.0, 10.0), (3, "s", 7, 5.0, 31.0)]
    assert rows(C.age_mismatches(found, people.limit(0))) == []
    dead = spark.createDataFrame([("李四",)], "name string")
    hits = C.living_dead(docs, dead, ["李四", "张三"])
    assert rows(hits) == [(4, "李四", 128), (4, "李四", 133)]
    assert rows(X.contradictions(docs, found, hits)) == [(4, 1)]
    scored = X.objective_scores(docs, ZH, issues=X.contradictions(docs, found, hits))
    assert rows(scored, "doc_id", "consistency") == [(1, 10), (2, 10), (3, 10), (4, 7)]
    assert {r.consistency for r in X.objective_scores(docs, ZH).collect()} == {7}


def test_quiet_windows(spark):
    said = lambda *xs: "\n".join(f"“{x}”" for x in xs)
    docs = spark.createDataFrame([(1, said(*"嗯哦啊嗯哦啊")), (2, said(*"嗯哦啊嗯哦", "因为")), (3, said(*"嗯哦啊嗯哦")), (4, "# " + said(*"嗯哦啊嗯哦啊"))], "doc_id int, text string")
    assert rows(V.quiet_windows(docs, "“([^”]*)”", "因为|所以")) == [(1, 2, 2), (2, 2, 1)]


def test_located_findings(spark):
    docs = spark.createDataFrame([(1, "“显然”他显然不知道。\n然而，可见显然。"), (2, "")], "doc_id int, text string")
    assert rows(V.located(docs, ZH)) == [
        (1, 1, 2, "narrative-ban-a", "blocking", "他显然不知道。"), (1, 1, 5, "narrative-ban-b", "advisory", "他显然不知道。"), (1, 2, 1, "ai-connector", "advisory", "然而，可见显然。"),
        (1, 2, 4, "narrative-ban-a", "blocking", "然而，可见显然。"), (1, 2, 6, "narrative-ban-a", "blocking", "然而，可见显然。"),
    ]
    report = V.reports(V.located(docs, ZH)).first()
    assert (report.n, report.code) == (5, 2) and report.report.startswith('[{"line_no":1,"col":2,"type":"narrative-ban-a","severity":"blocking"}')


def test_schema_kinds(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "minLength": 2, "enum": ["xx", "y"]}, "b": {"type": "array"}, "c": {"type": "object", "required": ["d"], "properties": {"d": {"type": "boolean"}}}, "e": {"type": "number", "maximum": 1}}}
    texts = ['{"a": "xx", "b": [1], "c": {"d": true}, "e": 0.5}', '{"a": "y", "b": {}, "c": {}, "e": 2}', '{"a": 3, "c": {"d": 1}}', "[1]", "{", None]
    got = V.schema_violations(spark.createDataFrame(list(enumerate(texts)), "i int, j string"), "i", "j", schema)
    assert rows(got) == [(1, "$.a", "minLength"), (1, "$.b", "type"), (1, "$.c.d", "required"), (1, "$.e", "maximum"), (2, "$.a", "type"), (2, "$.c.d", "type"), (3, "$", "type"), (4, "$", "json"), (5, "$", "json")]


def test_scores_of_a_book(spark):
    """Hand-made texts, one for each step of the ladders."""
    rhythm = "短。" + "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏天地玄黄。" * 2 + "快。走。" + "天地玄黄宇宙洪荒日月盈昃。"
    even = "天地玄黄宇。" * 8
    texts = {"few": "短。短。", "vivid": rhythm, "even": even, "banned": "他显然可见。显然。意味着什么。", "dashes": "天—地—玄—黄—宇—宙—洪—荒—"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in X.objective_scores(docs, ZH).collect()}
    assert {k: got[k].rhythm for k in ("few", "vivid", "even")} == {"few": 5, "vivid": 15, "even": 2}
    assert {k: got[k].baseline for k in texts} == {"few": 10, "vivid": 10, "even": 10, "banned": 3, "dashes": 7}
    assert {r.texture for r in got.values()} == {7} and {r.plot for r in got.values()} == {7}
    assert all(r.total == r.plot + r.rhythm + r.texture + r.consistency + r.baseline for r in got.values())
    long = spark.createDataFrame([(1, ("天地玄黄宇宙洪荒" * 62 + "天地玄黄") * 3), (2, ("他走，" + "天地玄黄宇宙洪荒" * 2 + "“看。”") * 100)], "doc_id int, text string")
    plot = {r.doc_id: r.plot for r in X.objective_scores(long, ZH).collect()}
    assert plot == {1: 15 - 8 - 5 - 2, 2: 13}
