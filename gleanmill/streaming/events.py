"""Streams of log events: each function runs what is available and returns the table that the stream has written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def source(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if _is_file(spark, path) else path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _run(df: DataFrame, mode: str) -> str:
    """Writes each micro-batch to a folder of its own number, so a batch that is tried again overwrites itself."""
    spark, out = df.sparkSession, _folder(df.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/_b={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return f"{out}/data"


def first_by_key(spark: SparkSession, path: str, keys: list[str], event_id: str) -> DataFrame:
    """Idempotent consumption: per key the least event id, kept as state across micro-batches."""
    agg = source(spark, path).groupBy(*keys).agg(F.min(event_id).alias(event_id))
    rows = spark.read.parquet(_run(agg, "update"))
    return rows.groupBy(*keys).agg(F.min(event_id).alias(event_id))


def status_projection(spark: SparkSession, path: str) -> DataFrame:
    """Per user the state after the latest event; a late event never overwrites a later one."""
    agg = source(spark, path).groupBy("user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    rows = spark.read.parquet(_run(agg, "update"))
    return rows.groupBy("user_id").agg(F.max_by(F.struct("events", "last_ts", "status"), "_batch").alias("s")).select("user_id", "s.*")


def tumbling(spark: SparkSession, path: str, width: str) -> DataFrame:
    """Extension: counts and sums by tumbling event-time windows under a watermark; complete once the stream ends."""
    e = source(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    agg = e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    rows = spark.read.parquet(_run(agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "v"), "update"))
    return rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", F.round("v", 4).alias("total")), "_batch").alias("s")).select("window_start", "event_type", "s.*")


def retry_topic(attempt: Column, permanent: Column) -> Column:
    """The retry ladder: one minute, ten minutes, one hour, then the dead-letter topic."""
    return F.when(permanent, "dlq").when(attempt == 0, "ok").when(attempt == 1, "retry-1m").when(attempt == 2, "retry-10m").when(attempt == 3, "retry-1h").otherwise("dlq")
