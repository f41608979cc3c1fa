"""Rules of writes as functions from old state and input to new state; the result is written with an overwrite.

Cards are rows of (material_id, source_key, ...). Nothing is locked: a micro-batch has one writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedupe_key

KEYS = ["material_id", "source_key"]


def version_number(name: Column, prefix: str) -> Column:
    """The number of a version such as `<prefix>-v12`; null if it has none."""
    return F.regexp_extract(name, rf"{prefix}-v(\d+)", 1).try_cast("long")


def guarded(old: DataFrame, new: DataFrame, key: str, version: str, prefix: str) -> DataFrame:
    """Rows of `new` that are no downgrade of `old`: (key, version) with one row per key on each side."""
    before = old.select(key, version_number(F.col(version), prefix).alias("_v"))
    mine = version_number(F.col(version), prefix)
    return new.join(before, key, "left").filter(F.col("_v").isNull() | mine.isNull() | (mine >= F.col("_v"))).drop("_v")


def replace_if_same(active: DataFrame, expected: DataFrame, new: DataFrame) -> DataFrame:
    """Compare and replace: a material whose active keys equal the expected ones gets the new set, any other keeps its own.

    All are (material_id, source_key), keys once. A column `replaced` says which of the two a row comes from.
    """
    a, e = active.withColumn("_a", F.lit(True)), expected.withColumn("_e", F.lit(True))
    same = a.join(e, KEYS, "full_outer").groupBy("material_id").agg(F.bool_and(F.col("_a").isNotNull() & F.col("_e").isNotNull()).alias("same")).filter("same").select("material_id")
    kept = active.join(same, "material_id", "left_anti").withColumn("replaced", F.lit(False))
    return kept.unionByName(new.join(same, "material_id", "left_semi").withColumn("replaced", F.lit(True)))


def add_only(old: DataFrame, new: DataFrame, excluded: DataFrame) -> DataFrame:
    """Old cards and those new ones that are neither excluded nor present by source key or by normalised question.

    Of new cards of a material with the same normalised question the one of the least source key comes in.
    """
    with_key = lambda x: x.withColumn("_q", dedupe_key(F.col("question")))
    fresh = with_key(new.join(excluded, KEYS, "left_anti").join(old, KEYS, "left_anti"))
    fresh = fresh.join(with_key(old).select("material_id", "_q"), ["material_id", "_q"], "left_anti")
    first = F.row_number().over(Window.partitionBy("material_id", "_q").orderBy("source_key"))
    fresh = fresh.withColumn("_n", first).filter("_n = 1").drop("_n", "_q")
    return old.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))


def refresh_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 without any."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def exclude(cards: DataFrame, excluded: DataFrame) -> DataFrame:
    """A soft delete: cards of excluded materials become inactive; nothing is removed."""
    gone = excluded.select("material_id").distinct().withColumn("_x", F.lit(True))
    return cards.join(gone, "material_id", "left").withColumn("active", F.col("active") & F.col("_x").isNull()).drop("_x")
