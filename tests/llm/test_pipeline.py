"""The corpus pipeline, stage by stage."""

import math
import os

import corpus_pipeline as P
from brute import brute_components, brute_leaks, brute_mix, brute_shards
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, quality
from lectern.llm.common import Scratch, collecting, sweep


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, n = docs.columns, docs.count()
    assert [k for k, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    good = P.quality(spark, docs, sf).cache()
    scored = quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in scored.where("predicted = 1").select("doc_id").collect())
    kept = P.near_copies(spark, good, sf).cache()
    groups = jaccard.jaccard_components(good).select("component_id").distinct().count()
    assert kept.columns == names and kept.count() == groups < good.count() < n
    clean = P.decontamination(spark, kept, sf).cache()
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert clean.columns == names and decontaminate.find_leaks(clean, items).count() == 0
    mixed = P.mixing(spark, clean, sf).cache()
    assert mixed.columns == names and mixed.join(clean, "doc_id", "left_anti").count() == 0
    out = P.sharding(spark, mixed, sf)
    assert out.count() == mixed.count() and out.where("shard not between 0 and 15").count() == 0


def test_run_by_brute_force(spark, sf):
    """All of run(), given what the classifier keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.withColumn("lot", F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), F.col("text"))).withColumn("g", F.xxhash64("text")).withColumn("d", F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.lit(1 << 30))).collect()}
    good = sorted(r.doc_id for r in P.quality(spark, docs, sf).select("doc_id").collect())
    alone = [i for i, _, c in brute_components([(i, rows[i].text) for i in good]) if c == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaky = {d for d, _ in brute_leaks([(i, rows[i].text) for i in alone], items)}
    clean = [i for i in alone if i not in leaky]
    taken = brute_mix([(i, rows[i].text, rows[i].source, rows[i].lot) for i in clean])
    times = {i: 1 if not (x := taken[i, rows[i].text])[0] else math.floor(x[3] / x[0] + 0.5) for i in clean}
    mixed = [i for i in clean for _ in range(times[i])]
    want = brute_shards([(i, rows[i].text, rows[i].g, rows[i].d) for i in mixed])
    out = P.run(spark, sf)
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard) for r in out.collect()]
    assert leaky and len(mixed) > len(clean) > 0 and sorted(got) == sorted(want)
    assert set(docs.columns) <= set(out.columns)


def test_scratch_is_swept_by_owner(spark):
    other = Scratch(spark, "other")
    with collecting() as made:
        one = Scratch(spark, "one")
        a = one.put(spark.range(3))
    two = Scratch(spark, "two")
    b, c = two.put(spark.range(4)), other.put(spark.range(5))
    sweep(spark, made)
    assert made == [one.root] and b.count() == 4 and c.count() == 5
    assert not os.path.exists(a._lectern_path.removeprefix("file://")) and os.path.exists(b._lectern_path.removeprefix("file://"))
