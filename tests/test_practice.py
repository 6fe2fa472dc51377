"""Rules at their limits, packets against a plain version, open threads and versions."""

import re

from pyspark.sql import functions as F

from lectern.functions.packs import ZH
from lectern.operators import handoffs as H
from lectern.operators import rules as U
from lectern.operators import usage as G
from lectern.operators.scan import Scan

TITLES = H.TITLES.values()


def states(spark, texts, registry=tuple((r, True) for r in U.ALL)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rule", F.lit("own"))
    return {(r.doc_id, r.rule): (r.status, r.actual, r.severity) for r in U.rule_states(docs, Scan(ZH), registry).collect()}


def test_rules_at_their_limits(spark):
    even = "".join("天地玄黄宇宙。" for _ in range(8))
    same = "\n".join(["天地一。", "天地二。", "天地三。"])
    cases = [
        ("R001", "没有天地玄，没有宇宙洪，终", "blocking", 1_000_000), ("R001", "没有天地玄黄", "info", 0),
        ("R002", "天——" * 4, "info", 4_000_000), ("R002", "天——" * 5, "advisory", 5_000_000), ("R002", "天——" * 8, "blocking", 8_000_000),
        ("R005", "显然，天", "blocking", 1_000_000), ("R005", "“显然”，天", "info", 0),
        ("R006", "然而天", "advisory", 1_000_000),
        ("R009", even, "blocking", 0), ("R009", "天。" * 7, "info", None), ("R009", "天。天地玄黄宇宙洪荒。" * 4, "info", 777_778),
        ("R010", "悲伤愤怒", "info", 2_000_000), ("R010", "悲伤愤怒绝望", "advisory", 3_000_000),
        ("R013", same, "advisory", 1_000_000), ("R013", "须臾间，天", "info", 1_000_000), ("R013", "须臾间，霎时间", "advisory", 2_000_000),
        ("R018", "天" * 200, "advisory", 5_000), ("R018", "天" * 199, "info", None),
        ("R019", "首先" * 5 + "天" * 190, "advisory", 5_000_000), ("R019", "首先" * 4 + "天" * 192, "info", 4_000_000), ("R019", "首先" * 5, "info", 0),
        ("R020", "天" * 1500, "advisory", 0), ("R020", "天" * 999, "info", None),
    ]
    got = states(spark, [t for _, t, _, _ in cases])
    for i, (rule, _, severity, actual) in enumerate(cases):
        want = ("passed" if severity == "info" else "failed", actual, severity)
        assert got[i, rule][::2] == want[::2], (rule, i, got[i, rule])
        assert actual is None and got[i, rule][1] is None or abs(got[i, rule][1] - actual) <= 200_000 * (rule == "R009"), (rule, i, got[i, rule])


def test_states_of_a_registry(spark):
    registry = (("R001", True), ("R002", False), ("R004", True), ("R007", True), ("R007", False), ("R008", True), ("R025", True), ("X", True))
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "没有天地玄，没有宇宙洪，终")], "doc_id long, text string")
    rows = U.rule_states(docs, Scan(ZH), registry)
    got = {(r.doc_id, r.rule): (r.status, r.reason) for r in rows.collect()}
    for i in (1, None, 3):
        assert got[i, "R001"] == ("failed" if i == 3 else "passed", None) and got[i, "R002"] == got[i, "R007"] == ("disabled", None)
        assert got[i, "R004"] == ("skipped", "manual_check_required") and got[i, "R008"] == ("skipped", "requires_external_script") and got[i, "R025"] == got[i, "X"] == ("skipped", "no_checker_defined")
    rates = {r.doc_id: (r.rules, r.passed, r.failed, r.skipped, r.disabled, r.rate, r.blocking, r.advisory) for r in U.execution_rates(rows).collect()}
    assert rates == {1: (7, 1, 0, 4, 2, 1000, False, False), None: (7, 1, 0, 4, 2, 1000, False, False), 3: (7, 0, 1, 4, 2, 0, True, False)}
    assert U.rule_states(docs.limit(0), Scan(ZH), registry).count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") <= 1


PACKETS = [
    "引子【衔接包】\n[角色当前状态]\n| 角色 | 位置 |\n|---|---|\n| 张三 | 东山 | 伤 | 怒 | 剑 | 金丹 | 生 |\n| 李四 | 城 |\n| 孤 |\n[伏笔]\n├─ 玉佩\n└─ 密信（已揭晓）\n无关一行\n[禁止矛盾]\n├─ ❌ 张三不能飞\n说明\n## 后文\n- 不算",
    "[衔接包 V2]\n## 角色当前状态\n| 张三 | 西山 |\n## 伏笔\n- 玉佩\n• 玉佩\n",
    "没有标记\n[状态锁定]\n├─ 张三 → 伤\n李四不能走\n其他\n[数值锁定]\n银两 = 3\n年龄：20\n空行\n\n[伏笔]\n- 玉佩（已回收）\n- 玉佩",
    "", None,
]


def plain_section(text: str, title: str) -> str | None:
    for p in (rf"\[{title}\][\s\S]*?(?=\n\[|\Z)", rf"【{title}】[\s\S]*?(?=\n【|\Z)", rf"(?:^|\n)#{{1,3}}\s*{title}[\s\S]*?(?=\n#{{1,3}}\s|\Z)"):
        if found := re.search(p, text):
            return found[0].strip() or None
    return None


def test_sections_equal_a_plain_version(spark):
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(PACKETS)], "book string, chapter long, text string")
    for r in H.packets(rows).collect():
        text = PACKETS[r.chapter] or ""
        found = re.search(r"【衔接包】[\s\S]*?(?=\n#{1,3}\s|【|\Z)", text) or re.search(r"\[衔接包[^\]]*\][\s\S]*?(?=\n#{1,3}\s|\[章节|\Z)", text)
        own = found[0] if found else text
        assert r.raw_length == len(own)
        assert {k: r[k] for k in H.TITLES} == {k: plain_section(own, t) for k, t in H.TITLES.items()}
    assert {len([k for k in H.TITLES if r[k]]) for r in H.packets(rows).collect()} >= {0, 3}


def test_chains_over_the_threshold_are_compacted(spark):
    rows = [("long", i, PACKETS[i % 3]) for i in range(1, 12)] + [("long", 2, PACKETS[2])] + [("short", i, PACKETS[0]) for i in range(10)] + [(None, 1, "x"), ("long", None, "x")]
    parsed = H.packets(spark.createDataFrame(rows, "book string, chapter long, text string"))
    old = H.to_compact(parsed)
    assert sorted((r.book, r.chapter) for r in old.collect()) == sorted([("long", i) for i in range(1, 9)] + [("long", 2)])
    assert H.to_compact(parsed, threshold=11).count() == 0 and H.to_compact(parsed, threshold=9, keep=1).where("book = 'short'").count() == 9
    items = {(r.kind, r.item): r.chapter for r in H.kept_items(old).collect()}
    assert items["resolved", "- 玉佩（已回收）"] == 2 and items["active", "- 玉佩"] == 2 and items["active", "─ 玉佩"] == 3 and items["resolved", "─ 密信（已揭晓）"] == 3
    assert items["forbidden", "─  张三不能飞"] == 3 and items["state_lock", "─ 张三 → 伤"] == items["state_lock", "李四不能走"] == items["value_lock", "银两 = 3"] == items["value_lock", "年龄：20"] == 2
    people = {r.name: (r.location, r.power, r.chapter) for r in H.last_states(old).collect()}
    assert people == {"李四": ("城", "", 6), "张三": ("东山", "金丹", 6)}
    (s,) = H.summaries(old).collect()
    assert (s.book, s.first, s.last, s.packets, s.characters, s.value_lock, s.resolved) == ("long", 1, 8, 9, 2, 2, 2)
    assert H.summaries(old.limit(0)).count() == H.kept_items(old.limit(0)).count() == H.last_states(old.limit(0)).count() == 0


def test_starts_of_threads_and_versions(spark):
    text = "ACTIVE 玉佩 第3章 出现，埋设于第20章\r\nDONE 第1章\nACTIVE 密信 第49章\nACTIVE 信物 第50章\nACTIVE 无"
    trackers = spark.createDataFrame([("b", text), ("c", text), (None, None)], "book string, text string")
    now = spark.createDataFrame([("b", 100), ("b", 7), ("c", 71), ("d", 900)], "book string, chapter long")
    got = sorted((r.book, r.line_no, r.start, r.age) for r in H.overdue_lines(trackers, now).collect())
    assert got == [("b", 1, 20, 80), ("b", 3, 49, 51), ("c", 1, 20, 51)]
    texts = ["Version: v2.1", "版本：V3", "# Skill V4.2", "see V1.2.3 here", "V5", "\n" * 29 + "V1.5", "\n" * 30 + "V1.5", "V1.0\nversion: V2.0", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", H.header_version("text").alias("v"))
    assert [r.v for r in rows.orderBy("i").collect()] == ["V2.1", "V3", "V4.2", "V1.2.3", None, "V1.5", None, "V2.0", None, None]


def test_usage_of_a_book(spark):
    texts = ["他握紧了拳头，倒吸一口凉气。月光洒在门上！\n山风吹过，他不是怕，而是怒", "前<chapter_content>握紧拳头。握紧拳头？握紧了拳头…握紧拳头。</chapter_content>握紧拳头", "", None]
    docs = spark.createDataFrame([(i, t, "书") for i, t in enumerate(texts)], "doc_id long, text string, source string").selectExpr("*", "1 as label", "2 as kind")
    got = {(r.doc_id, r.kind, r.label): (r.n, r.examples) for r in G.pattern_places(docs, G.ZH_BANK).collect()}
    assert got == {
        (0, "sentence", "握紧拳头"): (1, ["握紧了拳头"]), (0, "sentence", "倒吸凉气"): (1, ["倒吸一口凉气"]), (0, "sentence", "月光洒/照"): (1, ["月光洒"]), (0, "sentence", "风吹过…"): (1, ["风吹过"]),
        (0, "sentence", "不是A是B"): (1, ["不是怕，而是"]), (0, "body", "握拳"): (1, ["握紧了拳头"]), (0, "body", "吸气"): (1, ["倒吸一口凉气"]),
        (1, "sentence", "握紧拳头"): (4, ["握紧拳头", "握紧拳头", "握紧了拳头"]), (1, "body", "握拳"): (4, ["握紧拳头", "握紧拳头", "握紧了拳头"]),
    }
    assert {(r.label, r.kind): (r.total, r.chapters) for r in G.pattern_usage(docs, G.ZH_BANK).collect()}["握拳", "body"] == (5, 2)
    assert {r.word: r.total for r in G.image_usage(docs, G.ZH_IMAGES).collect()} == {"月光": 1, "风": 1, "拳": 5, "门": 1, "山": 1}
    each = {r.doc_id: (r.chars, r.sentences, r.mean, r.ellipsis, r.comma) for r in G.chapter_rhythm(docs).collect()}
    assert each == {0: (35, 3, 113, 0, 3), 1: (21, 3, 70, 1, 0), 2: (0, 0, 0, 0, 0), 3: (0, 0, 0, 0, 0)}
    (book,) = G.book_rhythm(docs).collect()
    assert (book.chapters, book.chars, book.warning, book.comma, book.ellipsis) == (4, 56, True, 8, 3)
    assert G.book_rhythm(docs.limit(0)).count() == G.pattern_usage(docs.limit(0), G.ZH_BANK).count() == 0


def test_threads_rates_and_order(spark):
    text = "# 🟢 表\n|---|🟢|\n| 玉佩 🟡 active |\r\n- 密信 已揭晓\n🔴\n无\n* CRITICAL 信物" + "长" * 100
    trackers = spark.createDataFrame([("b", text), (None, ""), ("c", None)], "book string, text string")
    threads = H.tracked_threads(trackers)
    got = sorted((r.line_no, r.status, r.text) for r in threads.collect())
    assert got == [(3, "yellow", "| 玉佩  active |"), (4, "black", "密信 已揭晓"), (5, "red", ""), (7, "red", "CRITICAL 信物" + "长" * 69)]
    assert [tuple(r) for r in H.thread_board(threads).collect()] == [("b", 0, 1, 2, 1)]
    chapters = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 99), (None, 7)], "book string, doc_id long")
    rates = spark.createDataFrame([(i, i * 10) for i in range(100)], "doc_id long, rate long")
    assert sorted(tuple(r) for r in H.recent_rates(chapters, rates).where("book is not null").collect()) == [("a", i, i * 10) for i in range(15, 25)] + [("b", 99, 990)]
    files = spark.createDataFrame([("x", 3), ("y", -1), ("z", 9), ("a", None), ("b", 9), ("c", 0)], "file string, lines long")
    assert [r.file for r in H.in_reading_order(files).collect()] == ["b", "z", "x", "c", "a", "y"]
