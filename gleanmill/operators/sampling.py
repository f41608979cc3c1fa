"""Samples that follow from the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Rows round(i * (n - 1) / (k - 1)) of each group, half to even; all rows of a group of at most k; k = 1: the middle."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(k - 1)), 0).cast("int")) if k > 1 else F.array(F.floor(F.col("_n") / 2).cast("int"))
    return numbered.filter((F.col("_n") <= k) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def round_robin(rows: DataFrame, topic: str, order: str) -> DataFrame:
    """turn and seen: order by them for the first of each topic, then the second of each, topics as first seen."""
    w = Window.partitionBy(topic)
    return rows.withColumn("turn", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("seen", F.min(order).over(w))
