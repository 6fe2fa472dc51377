"""Texts, JSON and Markdown as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.deltas import DELTA


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, chapter_no, modified, text of every Markdown and plain text file below a folder; a file is a row."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return rows.select(F.col("_metadata.file_path").alias("path"), T.chapter_number(name).alias("chapter_no"), F.col("_metadata.file_modification_time").alias("modified"), F.regexp_replace("value", "^﻿", "").alias("text"))


def read_checked_texts(spark: SparkSession, path: str, most: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects) of a folder: ``read_texts`` of the files that are UTF-8, and path, reason, length of those that aren't.

    Files are read as bytes; one that is gone when it is read is passed over, one
    above ``most`` bytes is rejected without being read.  A byte order mark is
    no part of a text.  Spark's readers pass over files without a byte, so these have no row.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").option("ignoreMissingFiles", "true").load(path)
    text = F.col("content").cast("string")
    reason = F.when(F.col("length") > most, "too long").when(~F.is_valid_utf8(text), "not UTF-8")
    small = rows.where(F.col("length") <= most)
    name = F.element_at(F.split("path", "/"), -1)
    texts = small.where(F.is_valid_utf8(text)).select("path", T.chapter_number(name).alias("chapter_no"), F.col("modificationTime").alias("modified"), F.regexp_replace(text, "^\ufeff", "").alias("text"))
    rejects = small.select("path", reason.alias("reason"), "length").where("reason is not null").unionByName(rows.where(F.col("length") > most).select("path", F.lit("too long").alias("reason"), "length"))
    return texts, rejects


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents over whole files; what doesn't parse is null."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def newest(files: DataFrame) -> DataFrame:
    """The path modified last; ties go to the last name."""
    return files.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def chapter_range(spark: SparkSession, literal: str) -> DataFrame:
    """chapter_no of each chapter of a literal such as ``1-10,20-30``; what isn't a range is skipped."""
    part = F.explode(F.split(F.lit(literal), r"\s*,\s*")).alias("p")
    rows = spark.range(1).select(part).where(F.col("p").rlike(r"^\d+(\s*-\s*\d+)?\z"))
    a = F.regexp_extract("p", r"^(\d+)", 1).cast("long")
    b = F.coalesce(F.nullif(F.regexp_extract("p", r"-\s*(\d+)\z", 1), F.lit("")).cast("long"), a)
    return rows.where(b >= a).select(F.explode(F.sequence(a, b)).alias("chapter_no")).distinct()


def markdown_table(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, cells: rows of Markdown tables, without headers and dividers."""
    from ..operators.structure import lines

    rows = lines(docs).withColumn("line", T.jtrim("line"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\z", ""), r"\|"), T.jtrim)
    bar = F.col("line").rlike(r"^\|.*\|\z")
    rule = F.col("line").rlike(r"^\|[\s:|-]+\|\z")
    from pyspark.sql import Window

    after = F.lead(rule).over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.withColumn("_head", F.coalesce(after, F.lit(False))).where(bar & ~rule & ~F.col("_head")).select("doc_id", "line_no", cells.alias("cells"))


def section(text: str | Column, title: str) -> Column:
    """Body of a titled section, whichever way the title is written: ``## t``, ``**t**`` or ``【t】``."""
    c = F.col(text) if isinstance(text, str) else text
    ways = (rf"(?s)(?:^|\n)#{{1,6}}\s*{title}[^\n]*\n(.*?)(?=\n#{{1,6}}\s|\z)", rf"(?s)\*\*{title}\*\*[：:]?\s*(.*?)(?=\n\*\*|\n#|\z)", rf"(?s)【{title}】\s*(.*?)(?=\n【|\n#|\z)")
    return F.coalesce(*[F.nullif(T.jtrim(F.regexp_extract(c, w, 1)), F.lit("")) for w in ways])


def tagged_body(text: str | Column, tag: str = "chapter_content") -> Column:
    """What a tag encloses, or the whole text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.nullif(F.regexp_extract(c, rf"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit("")), c)


def json_at(c: str | Column, path: str) -> Column:
    """Value at a path such as ``.a.b[0]``; ``[]`` goes through an array, and ``| length`` at the end counts its members."""
    c = F.col(c) if isinstance(c, str) else c
    bare, _, fn = (x.strip() for x in path.partition("|"))
    value = F.get_json_object(c, "$" + bare.replace("[]", "[*]"))
    return F.json_array_length(value).cast("string") if fn == "length" else value


#: Typed scans of a project's configuration.
SCHEMAS = {
    "rules": "rules array<struct<id:string,enabled:boolean,threshold:double,severity:string>>",
    "manifest": "samples array<struct<id:string,file:string,sha256:string,objective_score:double,blocking:long,advisory:long>>",
    "handoff": "chapter_no long, p0_fields struct<character_states:array<string>,forbidden_contradictions:array<string>>, foreshadowing array<struct<id:string,name:string,plant_chapter:long,current_status:string>>, version string",
    "delta": f"chapter long, delta {DELTA}",
    "state": "last_merged_chapter long, character_states array<struct<id:string,alive:boolean,combat_level:string>>, number_anchors struct<character_age:map<string,double>>, foreshadowing array<struct<id:string,status:string,planted_chapter:long,last_updated_chapter:long,last_summary:string>>, knowledge_boundary array<struct<character_id:string,known:array<string>,unknown:array<string>>>, timeline map<string,string>",
}


def read_config(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a configuration of one of the kinds in SCHEMAS, each with its ``path``."""
    return read_json(spark, path, SCHEMAS[kind]).withColumn("path", F.col("_metadata.file_path"))


def first_existing(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """chapter, path, score: of several candidate files of a chapter the one with the lowest priority; chapters without one stay, with nulls.

    ``chapters(chapter)``, ``files(chapter, priority, path, score)``.
    """
    best = files.groupBy("chapter").agg(F.min_by(F.struct("path", "score"), F.struct("priority", "path")).alias("_f"))
    return chapters.join(best, "chapter", "left").select("chapter", F.col("_f.path").alias("path"), F.col("_f.score").alias("score"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_index(postings: DataFrame, path: str) -> None:
    postings.write.mode("overwrite").partitionBy("kind").parquet(path)


def write_state(state: DataFrame, path: str, write: bool = False) -> DataFrame:
    """The state, which ``write`` also puts at ``path/json`` and, a line for each row, at ``path/markdown``; without it nothing is written."""
    if write:
        state.write.mode("overwrite").json(f"{path}/json")
        cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in state.columns])
        state.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value")).write.mode("overwrite").text(f"{path}/markdown")
    return state


def updated_manifest(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """``manifest(id, sha256, total, blocking)`` with what ``current`` measured anew; what was not measured stays."""
    c = current.select("id", *[F.col(x).alias(f"_{x}") for x in ("sha256", "total", "blocking")])
    return manifest.join(c, "id", "left").select("id", *[F.coalesce(f"_{x}", x).alias(x) for x in ("sha256", "total", "blocking")])


def replace_block(text: str | Column, name: str, body: str | Column) -> Column:
    """A text with what stands between ``<!-- name:start -->`` and ``<!-- name:end -->`` replaced; where there is no such block it is put at the end."""
    c = F.col(text) if isinstance(text, str) else text
    body = F.lit(body) if isinstance(body, str) else body
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    at, to = F.locate(start, c), F.locate(end, c)
    block = F.concat(F.lit(start + "\n"), body, F.lit("\n" + end))
    inside = F.concat(F.substring(c, F.lit(1), at - 1), block, F.substring(c, to + len(end), F.length(c)))
    return F.when((at > 0) & (to > at), inside).otherwise(F.concat(c, F.lit("\n"), block))


def append_snapshot(state: DataFrame, path: str, label: str, at: str) -> None:
    """Adds the rows of ``state``, named and dated, to the snapshots at ``path``."""
    append_log(state.withColumns({"label": F.lit(label), "at": F.lit(at).cast("timestamp")}), path)
