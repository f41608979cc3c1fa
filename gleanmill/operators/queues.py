"""Queue semantics as selections: what may be claimed, which results are stale, how far work is done without a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claimable(queue: DataFrame, now: Column, n: int) -> DataFrame:
    """The first n entries (a limit by purpose) that are due and whose lease is free or over, one attempt further.

    queue: (id, due, lease_until or null, attempt).
    """
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    return queue.filter((F.col("due") <= now) & free).orderBy("id").limit(n).withColumn("attempt", F.col("attempt") + 1)


def fenced(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results of the version that is active in their job, unless that job has ended: (job_id, version, ...) against (job_id, active_version, status)."""
    live = jobs.filter(~F.col("status").isin("DONE", "FAILED")).select("job_id", F.col("active_version").alias("version"))
    return results.join(live, ["job_id", "version"], "left_semi")


def committed(done: DataFrame, key: str, offset: str) -> DataFrame:
    """Per key the end of the prefix of offsets 0, 1, 2, ... that is done without a gap; no row if 0 is missing."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(offset)) - 1
    seen = done.select(key, offset).distinct().withColumn("_p", place)
    return seen.filter(F.col("_p") == F.col(offset)).groupBy(key).agg(F.max(offset).alias("committed"))


def expired(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks that are still open after their time."""
    return tasks.filter(F.col("status").isin("REQUESTED", "RUNNING") & (F.col("expires_at") <= now))


def past_retention(staged: DataFrame, now: Column) -> DataFrame:
    """Staging rows to remove: promoted ones after a day, failed ones after a week."""
    age = lambda h: F.col("updated_at") <= now - F.make_dt_interval(hours=F.lit(h))
    return staged.filter(((F.col("status") == "PROMOTED") & age(24)) | ((F.col("status") == "FAILED") & age(168)))
