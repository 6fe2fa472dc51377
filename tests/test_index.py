"""Postings, their grams, the index kept up by micro-batches, and triggers."""

import random

import pytest

from lectern.operators import postings as N
from lectern.operators import triggers as G
from lectern.streaming.index import NameIndex, keep_index

FILES = "file string, chapter long, source string, text string"
PATTERNS = {"tagged": "([A-Z][a-z]{2,7}) said", "upper": "([A-Z]{3,8})"}


def extract(files):
    return N.postings(files, ("Anna",), PATTERNS, ("She",), "W")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_postings_of_chinese_texts(spark):
    text = "张三说：“走。”\n他说要去天云城，了不得剑。\r\n【伏笔】张三"
    got = rows(N.postings(spark.createDataFrame([("1.md", 1, "chapter", text)], FILES), ("张三",)).select("keyword", "kind", "line", "pos"))
    assert ("张三", "character", 1, 1) in got and ("张三", "character", 3, text.index("【") + 5) in got and ("【伏笔】", "foreshadow", 3, text.index("【") + 1) in got
    assert all(k[0] not in N.PREFIXES or k == "张三" for k, *_ in got) and len(got) == len(set(got))


def test_keywords_by_grams_equal_a_scan(spark):
    rng = random.Random(6)
    word = lambda most: "".join(rng.choice("abc漢") for _ in range(rng.randint(1, most)))
    words, asked = [word(5) for _ in range(120)], [word(7) for _ in range(60)] + ["zz", ""]
    grams = N.keyword_grams(spark.createDataFrame([(w,) for w in words], "keyword string"))
    got = rows(N.matching_keywords(spark.createDataFrame([(q,) for q in asked], "query string"), grams))
    assert got == sorted({(q, w, q == w) for q in asked for w in words if q and (q in w or w in q)})


def test_index_over_batches_equals_one_full_build(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    text = lambda i: f"Anna met NORTH and Ben said so {i}\nBORIS" if i % 3 else "nothing"
    one = [(f"{i}.md", i, "chapter", text(i)) for i in range(12)]
    two = [("1.md", 1, "chapter", "EAST"), ("2.md", 2, "chapter", text(2)), ("3.md", 3, "chapter", "Anna")]
    three = [("4.md", 4, "chapter", None), ("5.md", 5, "chapter", None), ("1.md", 1, "chapter", "nothing"), ("20.md", 20, "handoff", "WEST")]
    seen = []

    def counted(files):
        seen.append(sorted(r.file for r in files.select("file").collect()))
        return extract(files)

    index = NameIndex(spark, f"file://{tmp_path}/index", counted, buckets=4)
    for part in (one, two, three):
        spark.createDataFrame(part, FILES).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = keep_index(spark.readStream.schema(FILES).json(f"{tmp_path}/in"), index, f"{tmp_path}/state")
        q.awaitTermination(120)
        assert q.exception() is None
    index.update(spark.createDataFrame(three, FILES))  # a batch that comes again changes nothing
    last = {r[0]: r for r in (*one, *two, *three)}
    full = extract(spark.createDataFrame([r for r in last.values() if r[3] is not None], FILES))
    assert rows(index.postings().select(full.columns)) == rows(full) != []
    assert sorted(r.file for r in index.files().collect()) == sorted(f for f, r in last.items() if r[3] is not None)
    assert seen[1] == ["1.md", "3.md"] and seen[2] == ["1.md", "20.md"] and seen[3] == []  # unchanged files are not read again
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_triggers_have_no_cap(spark):
    shape = "trigger string, kind string, value string, lo long, hi long"
    rows_ = [("odd", "unknown", "x", None, None)] + [(f"t{i}", "always", None, None, None) for i in range(1500)]
    context = spark.createDataFrame([(1, "a", "s", 7, ["x", "x"]), (2, None, None, None, None)], "id long, genre string, step string, chapter long, tags array<string>")
    assert G.triggered(spark.createDataFrame(rows_, shape), context).count() == 3000
    ranges = [(f"{a}-{b}", "chapters", None, a, b) for a in range(0, 40, 3) for b in range(a - 1, 60, 7)]
    many = spark.createDataFrame([(c, None, None, c, []) for c in range(70)], context.schema)
    got = rows(G.triggered(spark.createDataFrame([*ranges, ("n", "chapters", None, None, 3), ("g", "genre", None, None, None), ("tag", "tag", "x", None, None)], shape), many.unionByName(context.where("id = 1").selectExpr("id + 100 as id", "genre", "step", "chapter", "tags"))))
    want = [(c, f"{a}-{b}") for _, _, _, a, b in ranges for c in range(70) if a <= c <= b] + [(101, f"{a}-{b}") for _, _, _, a, b in ranges if a <= 7 <= b] + [(101, "tag")]
    assert got == sorted(want)


CONDITIONS = [
    ("all", "x", "always"), ("none", "x", None), ("in", "x", "scene_type in [core, Important]"), ("eq", "x", "scene_type == transitional"), ("tag", "x", "内容标签 = 战斗"), ("ratio", "x", "dialogue_ratio > 30"), ("new", "x", "新角色登场"),
    ("step", "步骤触发集", "03b 质检"), ("or", "x", 'genre == "玄幻" or "修仙"'), ("list", "x", "genre in [都市, 悬疑] and dialogue_ratio > 50"), ("early", "02a 模块", "首批建纲（前10章）"), ("later", "02a 模块", "滚动补纲"), ("climax", "02a 模块", "高潮章"), ("hand", "02a 模块", "发现细纲变对话脚本"),
]
CONTEXTS = [
    (1, "CORE", "战斗,日常", 31, True, "03B 质检", "修仙", 3, None), (2, "transitional", None, 30, False, "02a", "都市", 10, "opening"), (3, None, "", None, None, None, None, None, None), (4, "important", "日常", 60, False, "02A", "悬疑", 11, "climax"),
]
LOADED = {1: {"all", "none", "in", "tag", "ratio", "new", "step", "or"}, 2: {"all", "none", "eq", "early"}, 3: {"all", "none"}, 4: {"all", "none", "in", "ratio", "list", "later", "climax"}}


@pytest.mark.parametrize("copies", [1, 40])
def test_conditions(spark, copies):
    triggers = spark.createDataFrame([(f"{t}{k or ''}", s, c) for t, s, c in CONDITIONS for k in range(copies)], "trigger string, section string, condition string")
    contexts = spark.createDataFrame(CONTEXTS, "id long, scene string, content_tag string, dialogue_ratio long, new_character boolean, step string, genre string, chapter long, chapter_type string")
    got = rows(G.loaded(triggers, contexts))
    assert got == sorted((i, f"{t}{k or ''}") for i, ts in LOADED.items() for t in ts for k in range(copies))
