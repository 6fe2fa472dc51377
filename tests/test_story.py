"""Anchors by the Chinese rules against their SQL, on a table that holds each case."""

import compare
import pytest

from lectern.functions.packs import ZH
from lectern.operators import anchors as A
from lectern.plans import queries as plans

FOUND, SQL = plans.register(ZH)
NAMES = ("kinds_of_numbers", "age_anchors", "cultivation_anchors", "route_distances", "lone_fights", "beyond_tier", "narrator_overreach", "anchored_score")
ROWS = [
    (1, "张三今年二十三岁，三爷其实20岁，张三丰也说二十三岁。李四十九岁。"),
    (2, "快30了，年近40，年过五十；张三19岁。张三丰一百岁。"),
    (3, "从东山往南100里，又往北90里，再往南110里、南111里、东山约89里。"),
    (4, "天城外三公里，海城约55千米，海城约56千米，走了半日路，半天车程，八丈，差不多6步"),
    (5, "张三有三枚，三爷给了他四枚，李四5枚，七条，十二名，三百个。"),
    (6, "他独自面对金丹妖兽，一剑斩杀。随后碾压，一人又秒杀了筑基。"),
    (7, "他独自走路，路上遇见金丹，斩杀。"),
    (8, "炼气的敌人，" + "远" * 60 + "独自" + "近" * 60 + "斩杀筑基"),
    (9, "这就破防了\n“笑死”，他说\n打工人的一天\n心想真香\n「老板」摆烂\n他喊社死"),
    (10, "YYDS yyds emo了\n\n（佛系）躺平\n张三" + "说" + "一" * 25 + "麻了"),
    (11, ""),
    (12, "内卷"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import pyarrow.parquet as pq

    at = str(tmp_path_factory.mktemp("story"))
    spark.createDataFrame([(i, t, "都市", "b", len(t)) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/parts")
    pq.write_table(pq.read_table(f"{at}/parts"), f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_chinese_rules_equal_their_sql(spark, folder, name):
    compare.same(FOUND[name](spark, folder), SQL[name], folder)
    assert not FOUND[name](spark, folder).isEmpty()


def test_routes_at_their_limits(spark, folder):
    """Within a tenth is the same; another direction, another unit and another route say nothing."""
    got = sorted((r.doc_id, r.value, r.route) for r in FOUND["route_distances"](spark, folder).collect())
    assert (3, 111.0, "东山-西山") in got and (4, 56.0, "天城到海城") in got and (4, 3.0, "天城到海城") in got
    assert not [x for x in got if x[1] in (100.0, 110.0) and x[2] == "东山-西山"] and (4, 55.0, "天城到海城") not in got


def test_names_inside_longer_names(spark, folder):
    got = sorted((r.doc_id, r.name, r.value) for r in FOUND["age_anchors"](spark, folder).collect())
    assert (1, "张三", 23.0) in got and (1, "张三丰", 49.0) in got and (2, "张三", 19.0) in got and (2, "张三丰", 100.0) not in got


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (None, "三岁" * 3000)], "doc_id long, text string").selectExpr("*", "1 as kind", "2 as pos")
    found = A.numbers(docs, A.ZH)
    assert found.count() == 3000
    empty = spark.createDataFrame([], "name string, main string, age int")
    assert A.anchored(found, empty, "age", "age").count() == 0
    assert A.off_routes(found, spark.createDataFrame([], "route string, distance string"), A.ZH).count() == 0
    assert A.narrated(docs.limit(0), ZH.grades).count() == 0
