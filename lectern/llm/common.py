"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]++"

#: Spark's setting that removes the shuffle files of a finished execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words of a text as BIGINT; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is the session's ``spark.checkpoint.dir``.  Only a local session without
    that setting (a test) gets a folder of this machine; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("lectern.scratch.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("lectern.scratch.dir", path)
    return path.rstrip("/")


_collected: ContextVar[list[str] | None] = ContextVar("collected", default=None)


class Scratch:
    """Intermediate tables of one operator, in the shared folder.

    ``put`` writes a DataFrame as Parquet and returns it read back, which cuts
    the lineage and outlives a lost executor.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        if (own := _collected.get()) is not None:
            own.append(self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # the table replaces the shuffle files it came from
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lectern_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that ``put`` returned and nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._lectern_path)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def collecting():
    """A list of the folders of all ``Scratch`` made inside, by this thread of work; other queries of the session are not in it."""
    own: list[str] = []
    token = _collected.set(own)
    try:
        yield own
    finally:
        _collected.reset(token)


def sweep(spark: SparkSession, roots: list[str]) -> None:
    """Deletes folders of ``Scratch``; for a caller that has written what was read from them."""
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
