"""The index of names kept up as files come: only what changed is read again.

Postings and the hashes of files lie in partitions by a hash of the file's name.
A micro-batch rewrites the partitions of the files that changed and no others:
what they held of other files stays, and new postings are added.  The postings
are written before the hashes, so a batch that failed in between finds its files
changed still and does the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS = "keyword string, kind string, file string, chapter long, source string, line long, pos long, context string"
HASHES = "file string, hash string"


class NameIndex:
    """An index at ``path``, which driver and executors reach; ``extract`` makes postings of files(file, chapter, source, text)."""

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.extract, self.buckets = spark, path, extract, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, part: str, shape: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        schema = f"{shape}, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}") if there else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, buckets: DataFrame, part: str) -> None:
        """Writes the partitions of ``buckets``; each gets a row without a file, so that one left empty is rewritten too."""
        marks = buckets.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "bucket"], "bucket")
        rows.unionByName(marks).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{part}")

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS).where("file is not null").drop("bucket")

    def files(self) -> DataFrame:
        return self._read("files", HASHES).where("file is not null").drop("bucket")

    def update(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Takes in ``batch(file, chapter, source, text)``; a null text removes its file, the rows of one file must agree.

        A function for ``foreachBatch``.  Files whose text is as it was are left alone.
        """
        named = batch.where("file is not null").dropDuplicates(["file"]).withColumn("hash", F.sha2("text", 256)).withColumn("bucket", self._bucket())
        known = self._read("files", HASHES).where("file is not null")
        changed = named.join(known.select("file", F.col("hash").alias("_old")), "file", "left").where(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old").persist()
        try:
            buckets = changed.select("bucket").distinct()
            stay = lambda rows: rows.join(buckets, "bucket", "left_semi").join(changed.select("file"), "file", "left_anti")
            fresh = changed.where("text is not null")
            new = self.extract(fresh.select("file", "chapter", "source", "text")).withColumn("bucket", self._bucket())
            old = stay(self._read("postings", POSTINGS).where("file is not null"))
            self._write(old.unionByName(new.select(old.columns)), buckets, "postings")
            held = stay(known)
            self._write(held.unionByName(fresh.select(held.columns)), buckets, "files")
        finally:
            changed.unpersist()


def keep_index(files: DataFrame, index: NameIndex, checkpoint: str, **trigger):
    """Starts a stream that keeps ``index`` up with a streaming ``files(file, chapter, source, text)``."""
    return files.writeStream.foreachBatch(index.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
