"""Spaced-repetition analytics: due queues, roll-ups, ordering and the rules of writes, over plain tables.

Tables have the columns of the review schema: cards(card_id, material_id, due, active, reviewed), materials
(material_id, user_id, title_order), folders and membership. Every function is a plan; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quota(started: Column, remaining: Column, requested: Column) -> Column:
    """started + min(max(0, remaining), max(0, clamp(requested, 1, 100) - started))."""
    zero = F.lit(0)
    return started + F.least(F.greatest(zero, remaining), F.greatest(zero, F.least(F.greatest(requested, F.lit(1)), F.lit(100)) - started))


def due_groups(cards: DataFrame, materials: DataFrame, reviewed_today: DataFrame, now: Column, limit: int) -> DataFrame:
    """Materials with due cards: those begun today first, then new ones by order, up to the day's limit of groups.

    cards: (card_id, material_id, due); materials: (material_id, user_id, position); reviewed_today: (material_id).
    The new groups are ranked within their user, so no window spans the table.
    """
    due = cards.filter(F.col("due") <= now).groupBy("material_id").agg(F.min("due").alias("group_due"), F.count("*").alias("n_due"))
    groups = due.join(materials, "material_id")
    begun = reviewed_today.select("material_id").distinct().withColumn("begun", F.lit(True))
    marked = groups.join(begun, "material_id", "left").withColumn("begun", F.coalesce("begun", F.lit(False)))
    by_user = Window.partitionBy("user_id")
    ranked = marked.withColumn("started", F.count_if("begun").over(by_user)).withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "begun").orderBy(F.asc_nulls_last("position"), "group_due", "material_id")))
    keep = F.col("begun") | (F.col("rank") <= F.greatest(F.lit(0), F.lit(limit) - F.col("started")))
    return ranked.filter(keep).select("user_id", "material_id", "begun", "group_due", "n_due", F.col("rank").cast("long").alias("rank"))


def reorder(items: DataFrame, requested: DataFrame, key: str, position: str) -> DataFrame:
    """Requested ids first in the order of the list, the rest in stable order; (key, old, new position).

    items: (owner, key, position); requested: (owner, ids: array). Positions start at 0 within an owner.
    """
    asked = requested.select("owner", F.posexplode("ids").alias("pos", key)).groupBy("owner", key).agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("owner").orderBy(F.asc_nulls_last("pos"), F.asc_nulls_last(position), key)
    return items.join(asked, ["owner", key], "left").select("owner", key, F.col(position).alias("old"), (F.row_number().over(order) - 1).cast("long").alias("new"))


def upsert_by_source(old: DataFrame, new: DataFrame, excluded: DataFrame, protected: str = "^(manual|custom):") -> DataFrame:
    """The card table after a generation: generated cards replace texts but keep scheduling, others go inactive.

    old: (material_id, source_key, text, reps, active); new: (material_id, source_key, text); excluded keys never come.
    Cards whose key is protected stay as they are.
    """
    keys = ["material_id", "source_key"]
    fresh = new.join(excluded, keys, "left_anti").withColumn("fresh", F.lit(True)).withColumnRenamed("text", "new_text")
    both = old.join(fresh, keys, "full_outer")
    safe = F.col("source_key").rlike(protected)
    return both.select(
        *keys,
        F.coalesce("new_text", "text").alias("text"),
        F.coalesce("reps", F.lit(0)).alias("reps"),
        F.when(F.col("fresh"), True).when(safe, F.col("active")).otherwise(False).alias("active"),
    )


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Per key the row of the greatest version; a stale result never replaces a newer one."""
    fields = [c for c in rows.columns if c not in (key, version)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(version, *fields)).alias("row"), F.max(version).alias(version))
    return best.select(key, version, "row.*")


def append_sequence(existing: DataFrame, incoming: DataFrame, key: str, dedupe: str, order: str) -> DataFrame:
    """Incoming rows not present by (key, dedupe) get the next sequence numbers of their key."""
    once = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key, dedupe).orderBy(order))).filter("_n = 1").drop("_n")
    new = once.join(existing, [key, dedupe], "left_anti")
    last = existing.groupBy(key).agg(F.max("sequence_no").alias("last"))
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) + F.coalesce("last", F.lit(0))
    return new.join(last, key, "left").withColumn("sequence_no", at.cast("long")).drop("last")
