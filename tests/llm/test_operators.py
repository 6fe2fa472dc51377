"""The numbered operators against brute force, round trips and held-out labels."""

import base64
import math
import random
import re
import zlib

import compare
import numpy as np
import pandas as pd
import pytest
from brute import brute_components, brute_leaks, brute_mix, brute_shards
from pyspark.sql import functions as F

from lectern.llm import catalog, chat, decontaminate, jaccard, lines, mixing, neighbours, quality, sharding, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(20000))
    return [(1, None, None), (2, "", "a"), (3, " \t\n ", "a"), (4, "one", "b"), (5, "one", "b"), (6, long, "b"), (7, long + " tail", None), (7, long + " tail", None), (8, "ü – 漢字 two\nlines", "c")]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    compare.same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


@pytest.mark.parametrize("rows", [[], odd_rows()], ids=["empty", "odd"])
def test_edge_rows(spark, rows):
    docs = docs_of(spark, rows).withColumn("size", F.lit(1)).withColumn("shard", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    n = len(rows)
    assert mixing.mix(docs, docs.columns).count() == n and len(set(mixing.mix(docs, docs.columns).columns)) == len(docs.columns) + 4
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert sharding.shard_rows(docs.drop("size", "shard"), ["doc_id"]).count() == n
    assert decontaminate.find_leaks(docs, items).count() == 0
    assert decontaminate.clean_documents(docs, items).count() == n
    assert tokens.count_tokens(docs, F.lit(None).cast("array<struct<pos int, removed int, inserted string>>")).count() == n
    assert jaccard.jaccard_components(docs).count() == n
    assert jaccard.distinct_documents(docs).columns == docs.columns
    assert quality.score_quality(docs, labels).where("score between 0 and 1").count() == n
    assert lines.dedup_lines(docs).count() == lines.dedup_runs(docs).count() == n
    odd = docs.selectExpr("*", "1 as _row", "2 as wanted", "3 as gone", "4 as doc", "5 as _lines")
    assert [tuple(r) for r in lines.dedup_lines(odd).select("_row", "wanted", "gone", "doc").distinct().collect()] == [(1, 2, 3, 4)] * bool(n)


def test_edge_vectors_pages_chats(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (20, [float("nan"), 1.0]), (40, [0.0, 0.0]), (60, None), (61, [1.0, None]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(v, "id % 20 = 0").orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert neighbours.nearest(v.limit(0), "id % 20 = 0").count() == 0
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "a b", "x" * 200000), (3, "a b", "x" * 200000), (None, "u", "y")], "page_id long, url string, html string")
    got = warc.archive_pages(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(None, "response", None), (1, "revisit", 2), (2, "response", None), (3, "response", None), (3, "response", None)]
    more = pages.unionByName(spark.createDataFrame([(None, None, "x" * 200000), (None, "v", "y")], pages.schema))
    found = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.intact) for r in warc.archive_pages(more, payloads=False).collect())
    assert found == [(0, "response", 0, 1, True), (0, "response", 0, 1, True), (0, "revisit", 3, 200000, True), (1, "revisit", 2, 0, True), (2, "response", 0, 0, True), (3, "response", 0, 200000, True), (3, "response", 0, 200000, True)]
    assert warc.archive_pages(pages.limit(0)).count() == 0
    chats = spark.createDataFrame([(None, None, None, None), (1, 1, "user", "<s>[ROLE]%3C"), (1, 2, "tool</s>", "[/ROLE]")], "conv_id long, turn long, role string, text string")
    read = chat.format_chats(chats).withColumn("read", chat.read_chats(F.col("formatted"))).orderBy("conv_id").collect()
    assert [tuple(t) for t in read[1].read] == [("user", "<s>[ROLE]%3C"), ("tool</s>", "[/ROLE]")] and not read[1].valid
    assert chat.format_chats(chats.limit(0)).count() == 0


def test_apportionment_by_brute_force(spark):
    rng = random.Random(1)
    votes = [(f"k{i}", rng.random() * 1000) for i in range(12)]
    seats = dict.fromkeys((k for k, _ in votes), 0)
    for _ in range(500):
        best = max(votes, key=lambda kv: (kv[1] / (2 * seats[kv[0]] + 1), kv[0] == min(seats)))
        seats[best[0]] += 1
    rows = spark.createDataFrame(votes, "key string, vote double").withColumn("seats", F.lit(500))
    got = mixing.apportion(rows, [], "key", "vote", "seats", "won")
    assert {r.key: r.won for r in got.collect()} == seats


def test_op1_by_brute_force(spark, sf):
    lot = F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), F.col("text"))
    for shard_words in (1 << 18, 2000):
        docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("source") != "web", F.col("source")))
        want = brute_mix([tuple(r) for r in docs.select("doc_id", "text", "source", lot).collect()], shard_words=shard_words)
        got = mixing.mix(docs, ["doc_id", "text"], shard_words=shard_words).collect()
        assert len(got) == docs.count()
        for r in got:
            size, whole, target, taken = want[r.doc_id, r.text]
            assert (r["size"], r.source_size, r.taken) == (size, whole, taken) and r.target == pytest.approx(target)


def test_repeated_rows_share_the_mix(spark):
    docs = docs_of(spark, [(1, "a b c d e f g h", "s")] * 40 + [(None, "x y", None)] * 30)
    got = mixing.mix(docs, ["doc_id"]).toPandas()
    assert len(got) == 70 and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 41).all()


def test_mix_law(spark, sf):
    rows = catalog.queries()["op1_mixing"](spark, sf).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all() and (rows.taken >= 0).all()
    by = rows.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 2 * 1024).all()
    again = catalog.queries()["op1_mixing"](spark, sf).toPandas()
    assert sorted(map(tuple, rows.values.tolist())) == sorted(map(tuple, again.values.tolist()))


def test_op2_by_brute_force(spark, sf):
    rows = catalog.queries()["op2_sharding"](spark, sf).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() <= 1.25 * size.mean()
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    keys = (F.xxhash64("text"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit("piece")), F.lit(1 << 30)))
    want = brute_shards([tuple(r) for r in docs.select("doc_id", "text", *keys).collect()])
    assert sorted(want) == sorted(zip(rows.doc_id, rows["size"], rows.text_crc32, rows["shard"], strict=True))
    hot = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "the same").otherwise(F.concat("text", F.lit("x"))))
    got = sharding.shard_rows(hot, ["doc_id"]).toPandas()
    want = brute_shards([tuple(r) for r in hot.select("doc_id", "text", *keys).collect()])
    assert sorted(want) == sorted(zip(got.doc_id, got["size"], got.text_crc32, got["shard"], strict=True))
    small = got.groupby("text_crc32").agg(bytes=("size", "sum"), rows=("size", "count"), shards=("shard", "nunique"))
    small = small[(small.bytes * 32 < got["size"].sum()) & (small.rows * 32 < len(got))]
    assert len(small) > 50 and small.shards.max() == 1


def test_leaks_by_exhaustive_scores(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    a, b = (decontaminate.ItemIndex(items, 0.6, 0.5, block=k) for k in (8, 1))
    b.block_bounds = lambda terms: np.full((-(-len(terms) // b.stride), b.n_blocks), np.inf)  # every item is scored
    for t in texts:
        assert [(x[0], round(x[1], 9)) for x in a.leaks(t)] == [(x[0], round(x[1], 9)) for x in b.leaks(t)]
    planted = items[3][1]
    assert items[3][0] in [x[0] for x in a.leaks("before words " * 50 + planted + " after words" * 500)]
    assert a.leaks("nothing of the kind is written here " * 200) == []


def test_op3_by_brute_force(spark, sf):
    """All scores and overlaps, whatever the size of a chunk."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    half = items.selectExpr("item_id + 1000 as item_id", "substring(text, 1, int(length(text) * 0.7)) as text")
    docs = docs.unionByName(items.selectExpr("item_id + 100000 as doc_id", "concat('so it is said ', substring(text, 1, int(length(text) * 0.8)), ' and so on') as text"))
    for bench, chunks in ((items, [20000]), (items.unionByName(half), [20000, 7])):
        want = brute_leaks([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
        for chunk in chunks:
            got = {(r.doc_id, r.item_id): r[2:] for r in decontaminate.find_leaks(docs, bench, chunk=chunk).collect()}
            assert got.keys() == want.keys() and want
            assert all(got[k] == pytest.approx(want[k]) for k in want)
    kept = decontaminate.clean_documents(docs, items, chunk=7)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in brute_leaks([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])}


def test_edits_equal_recounts():
    rng = random.Random(7)
    bits = ["word", " the", "  ", "\n\n", "'s", "don't", "12", "é", "漢字", "!?", " x", "a" * 40]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 300, 3000])))
        own = tokens.CountedText(text)
        for _ in range(6):
            pos, cut, new = rng.randint(0, len(text) + 2), rng.choice([0, 1, 5, 200]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
            own.edit(pos, cut, new)
            at = min(pos, len(text))
            text = text[:at] + new + text[min(at + cut, len(text)) :]
            assert own.text() == text and own.n_tokens == tokens.CountedText(text).n_tokens


def test_op4_by_whole_encodings(spark, sf):
    """Counts before and after the edits are those of encoding the whole texts."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in tokens.vocabulary(tokens.VOCABULARY).splitlines() if x.strip())}
    coder = tiktoken.Encoding("whole", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in catalog.queries()["op4_token_counts"](spark, sf).collect()}
    texts = docs.select("doc_id", "text", tokens.sample_edits().alias("edits")).collect()
    assert len(got) == len(texts)
    for r in texts:
        text = r.text or ""
        assert got[r.doc_id].n_tokens == len(coder.encode_ordinary(text))
        for e in r.edits:
            at = min(e.pos, len(text))
            text = text[:at] + e.inserted + text[at + e.removed :]
        assert (got[r.doc_id].n_tokens_edited, got[r.doc_id].n_chars_edited, got[r.doc_id].n_edits) == (len(coder.encode_ordinary(text)), len(text), 3)


def test_components_by_brute_force(spark):
    rng = random.Random(5)
    base = [[f"v{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 6, 30, 90]))] for _ in range(25)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
        rows.append((i, rng.choice(["{}", "  {}\n", "{}"]).format(" ".join(w))))
    rows += [(900, None), (901, ""), (902, "A b"), (903, "a B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == brute_components(rows)


def test_op5_by_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, catalog.queries()["op5_jaccard_join"](spark, sf).collect())) == brute_components(rows)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = catalog.queries()["op6_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    rank = got.score.rank()
    good = got.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc >= 0.9


def test_op6_scores_are_sums_of_tables(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, got = quality.fit_quality(docs, labels), {r.doc_id: r.score for r in catalog.queries()["op6_quality_classifier"](spark, sf).collect()}
    for r in docs.collect():
        x = quality.features_of(r.text)
        bins = lambda cuts: [sum(c < v for c in own) for own, v in zip(cuts, x, strict=True)]
        fine, rough = bins(model.fine), bins(model.rough)
        total = model.base + sum(t[k] for t, k in zip(model.tables, fine, strict=True)) + sum(t[rough[i] * model.coarse + rough[j]] for (i, j), t in model.pair_tables.items())
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    known = {r.doc_id for r in labels.collect()}
    drawn = labels.where(~quality.held_out()).collect()
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in drawn} == {1, 2, 3, 4} and known


def test_repeated_chunks_go(spark):
    part = "\n".join(f"this line number {i} stands in many documents" for i in range(60))
    rows = [(i, f"own {i} a\nown {i} b\n{part}\nown {i} c\nown {i} d", "s") for i in range(5)] + [(9, "clean\nlines\nonly", "s")]
    got = {r.doc_id: r for r in lines.dedup_lines(docs_of(spark, rows)).collect()}
    seen = set()
    for i, text, _ in rows:  # brute force, in order
        kept = []
        for chunk in lines.chunks_of(text):
            if lines.inked_lines(chunk) < 2 or chunk not in seen:
                kept.append(chunk)
            seen.add(chunk)
        assert got[i].text == "".join(kept)
    assert all(got[i]._removed_lines >= 20 and f"own {i} a" in got[i].text and f"own {i} d" in got[i].text for i in range(1, 5))


def test_all_repeated_runs_go(spark):
    """Against all runs of lines that begin and end with ink, of 2 and more lines with ink or 50 and more words."""
    rng = random.Random(7)
    long = [" ".join(f"{x}{i}" for i in range(n)) for x, n in (("p", 50), ("q", 49), ("r", 80))]
    some = [*"abcdefgh", *long, "", " ", "ü\r"]
    rows = [(i, "\n".join(rng.choice(some) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randint(0, 9))), "s") for i in range(150)]
    part = "\n".join(f"passage {i}" for i in range(7))
    rows += [(200, f"x\n{part}\ny", "s"), (201, f"v\n{part}", "s"), (202, f"{part}\nw\n", "s"), (203, "passage 2\npassage 3", "s"), (204, f"t\n{long[0]}", "s"), (205, long[0] + "\n", "s"), (206, long[1], "s"), (207, None, "s"), (208, "a\nb\na\nb\na", "s")]
    seen, want = set(), {}
    for i, text, _ in rows:
        own = (text or "").split("\n")
        gone = set()
        for s in range(len(own)):
            for e in range(s, len(own)):
                run = own[s : e + 1]
                if run[0].strip() and run[-1].strip() and (sum(1 for x in run if x.strip()) >= 2 or len(" ".join(run).split()) >= 50):
                    if tuple(run) in seen:
                        gone |= set(range(s, e + 1))
                    seen.add(tuple(run))
        want[i] = (text if not gone else "\n".join(x for k, x in enumerate(own) if k not in gone), len(gone))
    got = {r.doc_id: (r.text, r._removed_lines) for r in lines.dedup_runs(docs_of(spark, rows)).collect()}
    assert got == want
    assert got[201] == ("v", 7) and got[202] == ("w\n", 7) and got[203] == ("", 2) and got[205] == ("", 1) and got[206][0] == long[1]
    assert {x for _, t, _ in rows if t for x in t.split("\n")} - {""} <= {x for t, _ in got.values() if t for x in t.split("\n")}


def test_chunks_find_most_of_long_runs_wherever_they_stand(spark):
    """Shifted by lines in front of them, passages go by their chunks; only lines around the outer chunk ends go by pairs of lines."""
    rng = random.Random(3)
    passages = ["\n".join(f"passage {p} line {i}" for i in range(80)) for p in range(6)]
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(rng.randint(1, 9))] + [passages[i % 6]] + [f"tail {i}"]), "s") for i in range(60)]
    got = {r.doc_id: r for r in lines.dedup_runs(docs_of(spark, rows)).collect()}
    seen = set()
    for i, text, _ in rows:  # brute force: chunks of two and more lines that occur before
        chunks = [c.removesuffix("\n") for c in lines.chunks_of(text)]
        whole = [c for c in chunks if c.count("\n") and c in seen]
        seen |= set(chunks)
        assert (got[i]._chunks, got[i]._removed_chunks, got[i]._chunk_lines) == (len(chunks), len(whole), sum(c.count("\n") + 1 for c in whole))
        assert got[i]._removed_lines == (80 if i >= 6 else 0) and ("passage" in got[i].text) == (i < 6)
    assert all(got[i]._chunk_lines > 0 for i in range(6, 60))


def test_runs_go_though_digests_of_chunks_collide(spark, monkeypatch):
    """Under a digest that all chunks share, units of lines decide, and only those with the bytes of a first one go."""
    part = "\n".join(f"line {i}" for i in range(30))
    rows = [(1, f"a\n{part}\nb", "s"), (2, f"c\n{part}\nd", "s"), (3, "e\nf\ng", "s")]
    want = {r.doc_id: (r.text, r._removed_lines) for r in lines.dedup_runs(docs_of(spark, rows)).collect()}
    unequal = spark.createDataFrame([(b"k", b"c")], "key binary, bytes binary")
    monkeypatch.setattr(lines, "unequal_chunks", lambda held, scratch, cut: unequal)
    got = {r.doc_id: (r.text, r._removed_lines) for r in lines.dedup_runs(docs_of(spark, rows)).collect()}
    assert got == want and got[2] == ("c\nd", 30)


def test_op7_removes_all_repeated_runs(spark, sf):
    """The query leaves no later pair of neighbouring lines with ink, and no later long line."""
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    seen, want = set(), {}
    for i, text in docs:
        own, gone = (text or "").split("\n"), set()
        ink = [k for k, x in enumerate(own) if x.strip()]
        spans = [*zip(ink, ink[1:]), *((k, k) for k in ink if len(own[k].split()) >= 50)]
        for s, e in spans:
            unit = tuple(own[s : e + 1])
            gone |= set(range(s, e + 1)) if unit in seen else set()
            seen.add(unit)
        kept = "\n".join(x for k, x in enumerate(own) if k not in gone)
        want[i] = (len(gone), len(kept), zlib.crc32(kept.encode()))
    got = {r.doc_id: (r.removed_lines, r.kept_chars, r.kept_crc32) for r in lines.op7_line_dedup(spark, sf).collect()}
    assert got == want and sum(x[0] for x in got.values()) > 0


def test_chunks_of_equal_digest_are_compared(spark):
    """Two chunks under one digest: only that with the bytes of the first goes."""
    kind = "doc struct<text string>, _row string, wanted array<struct<no int, key binary, is_first boolean>>"
    rows = [(("a\nb",), "x", [(0, b"k", True)]), (("a\nb",), "y", [(0, b"k", False)]), (("c\nd",), "z", [(0, b"k", False)]), (("e",), "w", None)]
    held, scratch = spark.createDataFrame(rows, kind), lines.Scratch(spark, "test")
    unequal = lines.unequal_chunks(held, scratch)
    assert [(bytes(r.key), bytes(r.bytes)) for r in unequal.collect()] == [(b"k", b"c\nd")]
    left = {r._row: r.wanted for r in lines._without(held, unequal).collect()}
    assert len(left["x"]) == len(left["y"]) == 1 and left["z"] == [] and left["w"] is None


def test_parities_never_rule_out_a_link(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        x = np.array(rng.sample(range(1 << 62), rng.choice([3, 60, 900])), dtype=np.uint64)
        y = np.concatenate((x[: rng.randint(0, len(x))], np.array(rng.sample(range(1 << 62), rng.randint(0, 40)), dtype=np.uint64)))
        x, y = np.unique(x), np.unique(y)
        rows.append((len(x), jaccard.folded(jaccard.bitmap(x)).tolist(), len(y), jaccard.folded(jaccard.bitmap(y)).tolist(), jaccard.linked(x, y, 80)))
    pairs = spark.createDataFrame(rows, "n long, p array<bigint>, m long, q array<bigint>, links boolean")
    own = pairs.selectExpr("struct(n, p as parity) x", "struct(m as n, q as parity) y", "links")
    got = own.groupBy("links").agg(F.max(~jaccard.parities_allow("x", "y", 80)).alias("lost")).collect()
    assert {r.links for r in got} == {True, False} and not next(r.lost for r in got if r.links)


def test_chunks_are_the_text():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice("ab\n\n \r") for _ in range(rng.randint(0, 80)))
        assert "".join(lines.chunks_of(t)) == t


def test_damage_is_seen():
    raw = warc.record(1, "http://x/é", b"<p>hello</p>", 12, warc.digest(b"<p>hello</p>"))
    whole = warc.parse(zlib.decompress(raw, 31))
    assert whole["intact"] and whole["url"] == "http://x/é" and whole["payload"] == b"<p>hello</p>"
    assert not warc.parse(zlib.decompress(raw, 31).replace(b"hello", b"hallo"))["intact"]


def test_records_are_framed_by_their_length():
    """Any way of cutting a stream gives the same records; a wrong length, a short member and bytes behind a record are seen."""
    rng, payloads = random.Random(3), [b"", b"a", b"\r\n\r\n" * 3, bytes(range(256)) * 900]
    raw = b"".join(warc.record(i, None, p, len(p), warc.digest(p)) for i, p in enumerate(payloads)) + warc.record(9, "u", None, 1, warc.digest(b"a"), 1)

    class Stream:
        def __init__(self, data, most):
            self.data, self.most = data, most

        def read(self, n):
            k = rng.randint(1, self.most)
            out, self.data = self.data[:k], self.data[k:]
            return out

    for most, size in ((1, 1), (7, 3), (1000, 50), (1 << 20, 1 << 16)):
        got = [warc.frame(m) for m in warc.members(Stream(raw, most), size)]
        assert [(r["page_id"], r["payload"], r["intact"]) for r in got] == [(i, p, True) for i, p in enumerate(payloads)] + [(9, None, True)]
        assert got[-1]["refers_to"] == 1 and got[-1]["record_type"] == "revisit"
    plain = zlib.decompress(warc.record(1, None, b"hello", 5, warc.digest(b"hello")), 31)
    for bad in (plain[:-1], plain + b"x", plain.replace(b"hello", b"hell"), plain.replace(b"hello", b"hello!")):
        assert not warc.parse(bad)["intact"]
    with pytest.raises(ValueError):
        [warc.frame(m) for m in warc.members(Stream(raw[:-9], 50))]


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(rows.embedding.tolist(), dtype=float), rows.vec_id.to_numpy()
    hit = total = 0
    got = neighbours.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), "id % 20 = 0", shard_rows=200).toPandas()
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and mine.score.is_monotonic_decreasing
        hit, total = hit + len(set(best) & set(mine.vec_id)), total + 20
    assert hit / total >= 0.9


@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
def test_recall_of_vectors_with_and_without_structure(spark, kind):
    """One graph of 6,000 vectors in default shards, against brute force."""
    rng = np.random.default_rng(0)
    v = rng.standard_normal((6000, 64))
    if kind == "clustered":
        v = rng.standard_normal((60, 64))[rng.integers(0, 60, 6000)] + 0.3 * v
    table = pd.DataFrame({"vec_id": np.arange(6000), "embedding": v.tolist()})
    got = neighbours.nearest(spark.createDataFrame(table), "id % 20 = 0").toPandas()
    hit = 0
    for q, own in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        assert len(own) == 20
        hit += len(set(np.argsort(-s)[:20]) & set(own.vec_id))
    assert got.query_id.nunique() == 300 and hit / (300 * 20) >= 0.9


def test_every_node_gets_a_way_in():
    rng = np.random.default_rng(1)
    x = neighbours.equal_norms(rng.standard_normal((3000, 48)))
    edges, entry = neighbours.build_graph(x, degree=8, width=16)
    whole = neighbours.with_ways_in(edges, entry, least=2, room=4)
    assert not neighbours.reached(edges, entry).all() and neighbours.reached(whole, entry).all()
    assert (whole[:, :8] == edges).all()
    star = np.full((2001, 2), 2000, dtype=np.int64)  # no edge at all
    assert neighbours.reached(neighbours.with_ways_in(star, 0, room=4), 0).all()
