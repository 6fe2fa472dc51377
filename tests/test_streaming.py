"""Chapter deltas and due checks in batch and as streams: the same rows over micro-batches, in any order, and after a restart."""

import json
import random
import time

import pytest

from lectern.operators import deltas as D
from lectern.streaming.deltas import delta_stream
from lectern.streaming.trigger import due_stream


def delta(lives=(), ages=None, ops=(), known=(), when=None):
    return {
        "character_states": [dict(zip(("id", "alive", "combat_level"), (*x, None, None), strict=False)) for x in lives], "number_anchors_updated": {"character_age": ages} if ages is not None else None,
        "foreshadowing_ops": [dict(zip(("id", "action", "summary"), (*x, None), strict=False)) for x in ops], "knowledge_boundary_updates": [dict(zip(("character_id", "newly_known", "still_unknown"), x, strict=True)) for x in known], "timeline": when,
    }


#: Six chapters of one book, and two of another that knows no ids: valid, skipped, resurrection, falling age, unknown ids, unknown action.
ROWS = [
    ("a", 1, 1, delta([("li", True, "low"), ("wu", False)], {"li": 20.0}, [("f1", "plant", "a ring"), ("f9", "hint")], [("li", ["x", "y"], ["z"])], {"day": "1"})),
    ("a", 2, 3, delta([("li", True)])),
    ("a", 3, 2, delta([("wu", True)])),
    ("a", 4, 2, delta([], {"li": 19.0})),
    ("a", 5, 2, delta([("xx", True)], None, [("f7", "reap")])),
    ("a", 6, 2, delta([], None, [("f1", "burn")])),
    ("a", 7, 2, delta([("li", None, "high")])),
    ("a", 8, 2, delta([("li", None, "mid")], {"wu": 5.0}, [("f1", "advance"), ("f1", "reap", "")], [("li", ["y", "w"], None)], {"day": "2", "hour": "9"})),
    ("a", 9, 3, delta([], {"li": 1.0})),
    ("b", 10, 1, delta([("any", True, "high")], None, [("f5", "reap", "s")])),
    ("b", 11, 0, delta([("", None)], None, [(None, None)])),
    ("b", 12, 2, None),
    (None, 13, 1, delta()),
    (None, 14, None, delta()),
]
KNOWN = [("a", ["li", "wu"], ["f1", "f9"], ["low", "mid", "high"], "mid")]
WANT = {
    1: [], 2: ["continuity 2"], 3: ["resurrection wu"], 4: ["age li"], 5: ["unknown character xx", "unknown foreshadowing f7"], 6: ["action burn"], 7: ["tier li"], 8: [], 9: [],
    10: [], 11: ["action null", "chapter", "character id", "continuity 2", "foreshadowing id"], 12: ["delta"], 13: [], 14: ["chapter", "continuity 2"],
}


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # each has a state store and a Python worker
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, D.DELTAS)


def test_every_delta_has_its_ruling(spark, rows):
    got = D.rulings(rows.repartition(5), spark.createDataFrame(KNOWN, D.BOOKS)).collect()
    assert {r.seq: list(r.errors) for r in got} == WANT
    assert all((r.status == "synced") == (not r.errors) for r in got) and len(got) == len(ROWS)
    assert D.rulings(rows.limit(0)).count() == 0


def test_state_of_accepted_deltas(spark, rows):
    synced = D.accepted(rows, D.rulings(rows, spark.createDataFrame(KNOWN, D.BOOKS))).where("book = 'a'")
    assert sorted(tuple(r)[1:] for r in D.character_state(synced).collect()) == [("li", True, "mid"), ("wu", False, None)]
    assert [tuple(r)[1:] for r in D.foreshadowing_state(synced).collect()] == [("f1", "reap", 1, 2, "a ring")]
    assert [(list(r.known), list(r.unknown)) for r in D.knowledge_state(synced).collect()] == [(["x", "y", "w"], ["z"])]
    assert {r.key: r.value for r in D.timeline_state(synced).collect()} == {"day": "2", "hour": "9"}
    assert [tuple(r) for r in D.age_state(synced).collect()] == [("a", "li", 1.0)]


def run(stream, at, name, rows):
    """Until so many rows have been read and a later batch has ended; a stream with timers never ends by itself."""
    q = stream.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-state").outputMode("append").start()
    end = time.time() + 60
    while time.time() < end and q.exception() is None:
        done = q.recentProgress
        read = [k for k, p in enumerate(done) if p["numInputRows"]]
        if sum(p["numInputRows"] for p in done) >= rows and (not name.startswith("due") or len(done) > read[-1] + 1):
            break
        time.sleep(0.2)
    q.stop()
    assert q.exception() is None and sum(p["numInputRows"] for p in q.recentProgress) >= rows


def test_delta_stream_equals_batch_over_a_restart(spark, rows, tmp_path):
    books = spark.createDataFrame(KNOWN, D.BOOKS)
    batch = sorted((r.seq, r.status, list(r.errors)) for r in D.rulings(rows, books).where("book is not null").collect())
    for cut in ((0, 6), (6, 14)):
        part = [r for r in ROWS[cut[0] : cut[1]] if r[0]]
        random.Random(1).shuffle(part)
        spark.createDataFrame(part, D.DELTAS).repartition(2).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(D.DELTAS).json(f"{tmp_path}/in")  # a new query goes on from the state that the last one left
        run(delta_stream(stream, books), tmp_path, "ruled", len(part))
    assert sorted((r.seq, r.status, list(r.errors)) for r in spark.read.parquet(f"{tmp_path}/ruled").collect()) == batch


def test_due_stream_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(b, n) for b, most in (("a", 23), ("b", 4), ("c", 11)) for n in range(1, most + 1)] + [("a", 7), ("c", 1)]
    rng.shuffle(rows)
    want = sorted(map(tuple, D.due_checks(spark.createDataFrame(rows, "book string, chapter_no long")).collect()))
    assert want == [("a", 5, 0), ("a", 10, 5), ("a", 15, 10), ("a", 20, 15), ("c", 5, 0), ("c", 10, 5)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], "book string, chapter_no long").repartition(2).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema("book string, chapter_no long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        run(due_stream(stream), tmp_path, "due", len(rows[k::2]))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/due").collect())) == want


def test_a_gap_is_passed_over_when_its_time_is_up(spark, tmp_path):
    rows = [("a", n) for n in (1, 2, 4, 5, 6, 9, 12)]
    assert sorted(map(tuple, D.due_checks(spark.createDataFrame(rows, "book string, chapter_no long")).collect())) == [("a", 5, 0), ("a", 12, 5)]
    for k, part in enumerate([rows, [("b", 1)], [("b", 2)]]):
        spark.createDataFrame(part, "book string, chapter_no long").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema("book string, chapter_no long").json(f"{tmp_path}/in")
        run(due_stream(stream, patience=1), tmp_path, "due", len(part))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/due").collect())) == [("a", 5, 0), ("a", 12, 5)]


def test_facts_are_json(spark, rows):
    assert all(json.loads(r.facts) is not None for r in D.prepared(rows).collect())
