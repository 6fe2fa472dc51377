"""The corpus pipeline: quality, near copies, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import Scratch, collecting, sweep, table
from lectern.llm.decontaminate import clean_documents
from lectern.llm.jaccard import distinct_documents
from lectern.llm.mixing import mixed_documents
from lectern.llm.quality import good_documents
from lectern.llm.sharding import shard_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with its shard."""
    return shard_rows(docs, docs.columns)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The classifier is learnt and documents are drawn by hashes, which SQL can't express; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage left in the shared folder goes once its result is written, and so
    does the result of the stage before.
    """
    docs, last = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with collecting() as made:
            docs = stage(spark, docs, sf_dir)
        result = Scratch(spark, "pipeline-" + name.replace(" ", "-"))
        docs = result.put(docs)
        sweep(spark, made + last)
        last = [result.root]
