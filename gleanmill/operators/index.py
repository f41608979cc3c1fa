"""The chunk index: block chunks with carried sections, parent summaries, versioned promotion, and replacing writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import extract_summary, normalized
from . import chunking

#: Blocks that are never split, and what stands before a parent's summary.
ATOMIC = ("table", "image", "chart", "formula", "code")
SUMMARY_MARK = "父段摘要："
SUMMARY = 260


def _parts(text: pd.Series) -> pd.Series:
    return pd.Series([[{"text": c, "heading": h} for _, c, h in chunking.pieces(t or "")] for t in text])


def block_chunks(blocks: DataFrame, default: str = chunking.WHOLE) -> DataFrame:
    """blocks (document_id, place, block_type, section_title, text): chunks (document_id, position, chunk_id, section, block_type, text).

    A section goes on until the next one; titles, heading blocks and chunks whose first line is a heading open one.
    Tables, images, charts, formulas and code stay whole and open none, other blocks are split. Empty blocks give no
    chunk and open no section.
    """
    text = normalized(F.coalesce("text", F.lit("")))
    block = F.when(F.col("block_type") == "heading", F.nullif(F.regexp_replace("text", "^[# :：]+|[# :：]+$", ""), F.lit("")))
    opened = F.coalesce(block, F.nullif(F.col("section_title"), F.lit("")))
    whole = F.array(F.struct(F.col("text"), F.lit(None).cast("string").alias("heading")))
    parts = F.when(F.col("block_type").isin(*ATOMIC), whole).otherwise(F.pandas_udf(_parts, "array<struct<text:string,heading:string>>")("text"))
    kept = blocks.withColumn("text", text).filter("text <> ''").select("document_id", "place", "block_type", opened.alias("opened"), F.posexplode(parts).alias("part", "p"))
    w = Window.partitionBy("document_id").orderBy("place", "part")
    opens = F.coalesce("p.heading", F.when(F.col("part") == 0, F.col("opened")))
    each = kept.withColumn("section", F.coalesce(F.last(opens, ignorenulls=True).over(w), F.lit(default))).withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    return each.select("document_id", "position", F.concat_ws("-", "document_id", "position").alias("chunk_id"), "section", "block_type", "p.text")


def parent_summaries(chunks: DataFrame) -> DataFrame:
    """chunks (document_id, position, parent_id, kind, text): one summary chunk for each parent, numbered as parents are first seen.

    Summaries are no source of summaries; chunks without a parent have none.
    """
    own = chunks.filter(~F.coalesce("kind", F.lit("")).isin("summary", "video_segment_summary") & (F.coalesce("parent_id", F.lit("")) != ""))
    of = own.groupBy("document_id", "parent_id").agg(F.min("position").alias("first"), F.array_sort(F.collect_list(F.struct("position", "text"))).alias("parts"))
    source = F.array_join(F.transform(F.filter("parts", lambda p: F.trim(p["text"]) != ""), lambda p: p["text"]), "\n")
    said = of.select("document_id", "parent_id", "first", F.size("parts").cast("long").alias("n_children"), extract_summary(source, SUMMARY).alias("summary"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("first"))
    numbered = said.withColumn("k", number).filter("summary <> ''")
    return numbered.select("document_id", "parent_id", F.concat("document_id", F.lit("-summary-"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("chunk_id"), F.concat(F.lit(SUMMARY_MARK), "summary").alias("text"), "n_children")


def promote(current: DataFrame, staged: DataFrame) -> DataFrame:
    """What becomes of each document: (document_id, action, version). current: (document_id, version, job_id); staged: (document_id, version, job_id, expected, found).

    The highest staged version counts. The same job and version again changes nothing, a lower one is rejected, as is one whose chunks are not all there.
    """
    last = staged.groupBy("document_id").agg(F.max_by(F.struct("version", "job_id", "expected", "found"), F.struct("version", "job_id")).alias("s"))
    met = last.join(current.withColumnRenamed("version", "_v").withColumnRenamed("job_id", "_j"), "document_id", "left")
    action = (
        F.when(F.col("_v").isNotNull() & (F.col("s.version") < F.col("_v")), "reject_lower").when((F.col("s.version") == F.col("_v")) & (F.col("s.job_id") == F.col("_j")), "no_change")
        .when(F.col("s.expected") != F.col("s.found"), "reject_incomplete").otherwise("replace")
    )
    return met.select("document_id", action.alias("action"), F.when(action == "replace", F.col("s.version")).otherwise(F.col("_v")).alias("version"))


def write(chunks: DataFrame, path: str, buckets: int = 16) -> int:
    """Writes chunks (document_id, ...) to an index of buckets of documents, in place of those of the same documents; their number.

    Only buckets with incoming documents are written again. The number of rows is checked after the write.
    """
    spark: SparkSession = chunks.sparkSession
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    new, asked = chunks.withColumn("bucket", bucket), chunks.select("document_id").distinct()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.parquet(path).join(new.select("bucket").distinct(), "bucket", "left_semi").join(asked, "document_id", "left_anti")
        staged = f"{path.rstrip('/')}-staged"
        old.unionByName(new).write.mode("overwrite").parquet(staged)  # what is read is never overwritten at once
        rows = spark.read.parquet(staged)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    else:
        new.repartition("bucket").write.partitionBy("bucket").parquet(path)
    want, got = chunks.count(), spark.read.parquet(path).join(asked, "document_id", "left_semi").count()
    if want != got:
        raise RuntimeError(f"index: {got} rows of {want} after the write")
    return got
