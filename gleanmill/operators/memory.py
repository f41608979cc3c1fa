"""Agent memory and context windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import recency, scope_priority


def newest_within(messages: DataFrame, key: str, order: str, tokens: str, budget: int) -> DataFrame:
    """The newest messages whose running token sum fits the budget; the newest always."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    summed = messages.withColumn("suffix_tokens", F.sum(tokens).over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(newest))
    return summed.filter((F.col("suffix_tokens") <= budget) | (F.col("_n") == 1)).drop("_n")


def memory_score(relevance: Column, importance: Column, days: Column, confidence: Column, scope: Column, rank: Column) -> Column:
    return 0.40 * relevance + 0.20 * importance + 0.15 * recency(days) + 0.15 * confidence + 0.10 * scope_priority(scope) - rank * 1e-4


#: Words of a refusal and of a preference.
NEGATIVE, POSITIVE = ("不要", "不再", "避免", "禁止"), ("喜欢", "优先", "以后都", "保持")


def first_of_hash(candidates: DataFrame, order: list[str], source_hash: str, content: str) -> DataFrame:
    """The first candidate of each source hash; one without a hash has that of its content."""
    key = F.coalesce(F.when(F.col(source_hash) != "", F.col(source_hash)), F.sha2(content, 256))
    w = Window.partitionBy("_k").orderBy(*order)
    return candidates.withColumn("_k", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_k", "_n")


def relations(candidates: DataFrame, existing: DataFrame, negative: tuple[str, ...] = NEGATIVE, positive: tuple[str, ...] = POSITIVE) -> DataFrame:
    """DUPLICATES, CONFLICTS_WITH or REFINES of each candidate, by the first older item of its subject that it repeats or contradicts.

    candidates: (candidate_id, namespace, subject, content); existing: (namespace, subject, content, place).
    """
    has = lambda c, words: reduce(Column.__or__, [c.contains(w) for w in words])
    old, new = F.trim("old"), F.trim("content")
    kind = F.when(old == new, "DUPLICATES").when((has(old, negative) & has(new, positive)) | (has(new, negative) & has(old, positive)), "CONFLICTS_WITH")
    met = candidates.join(existing.select("namespace", "subject", F.col("content").alias("old"), "place"), ["namespace", "subject"]).withColumn("kind", kind).filter("kind is not null")
    first = met.groupBy("candidate_id").agg(F.min_by("kind", "place").alias("kind"))
    return candidates.select("candidate_id").join(first, "candidate_id", "left").select("candidate_id", F.coalesce("kind", F.lit("REFINES")).alias("relation"))


def recall_terms(goal: Column, most: int = 12) -> Column:
    """The first words of two letters or digits and more."""
    return F.slice(F.filter(F.regexp_extract_all(F.lower(goal), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 2), 1, most)


def summary_for(goals: DataFrame, summaries: DataFrame) -> DataFrame:
    """goals (goal_id, task_id, goal) with the place of the first summary (task_id, place, text) that has one of the goal's words, else of the first."""
    both = goals.select("goal_id", "task_id", recall_terms(F.col("goal")).alias("terms")).join(summaries.select("task_id", "place", F.lower("text").alias("text")), "task_id")
    hit = F.exists("terms", lambda t: F.contains(F.col("text"), t))
    return both.groupBy("goal_id").agg(F.coalesce(F.min(F.when(hit, F.col("place"))), F.min("place")).alias("place"))


def append_messages(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming messages (task_id, dedupe_key, place, ...) that a task does not have yet, numbered on from its last; the first of equal keys."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy("task_id", "dedupe_key").orderBy("place"))).filter("_n = 1").drop("_n")
    new = first.join(existing.select("task_id", "dedupe_key"), ["task_id", "dedupe_key"], "left_anti")
    last = existing.groupBy("task_id").agg(F.max("sequence_no").alias("_last"))
    number = F.row_number().over(Window.partitionBy("task_id").orderBy("place"))
    return new.join(last, "task_id", "left").withColumn("sequence_no", (F.coalesce("_last", F.lit(0)) + number).cast("long")).drop("_last")
