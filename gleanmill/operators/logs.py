"""Log events: fingerprints of errors, idempotent inserts, and their streaming forms."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprints(events: DataFrame, key: Column, ts: str, event_id: str) -> DataFrame:
    """One row per fingerprint: occurrences, first and last time, and the first event."""
    return events.groupBy(F.sha2(key, 256).alias("fingerprint")).agg(F.count("*").alias("occurrences"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.min_by(event_id, F.struct(ts, event_id)).alias("sample"))


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored; of several with one key the first."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.join(stored, keys, "left_anti")


#: Parts and names of keys whose values are not logged, and the bounds of a context.
SENSITIVE_PARTS = ("password", "token", "authorization", "cookie", "secret", "apikey", "api_key", "dashscope")
SENSITIVE_NAMES = ("content", "question", "answer", "resume", "jd")
DEEPEST, MOST_ITEMS, LONGEST = 4, 50, 500
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def _safe(key: str, value, depth: int):
    if value is None:
        return None
    name = key.lower()
    if name in SENSITIVE_NAMES or any(p in name for p in SENSITIVE_PARTS):
        return "***"
    if isinstance(value, dict):
        return {"truncatedDepth": True} if depth > DEEPEST else {k: _safe(k, v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [_safe(key, v, depth + 1) for v in value[:MOST_ITEMS]]
    return value[:LONGEST] if isinstance(value, str) else value


def _redacted(context: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if not isinstance(text, str):
            return None
        try:
            found = json.loads(text)
        except ValueError:
            found = None
        return json.dumps(_safe("", found, 0), ensure_ascii=False, separators=(",", ":")) if isinstance(found, dict) else '{"serializationError":true}'

    return pd.Series([one(t) for t in context], dtype=object)


def redacted(context: Column) -> Column:
    """JSON contexts of any nesting without sensitive values; what is no JSON object is marked."""
    return F.pandas_udf(_redacted, "string")(context)


def ingest(batch: DataFrame, most: int | None = None) -> DataFrame:
    """batch (event_id, level, module, message, context): accepted, the reason against it, and the redacted context.

    most: how many rows of a batch a caller may send; rows beyond it, by event_id, are refused, not lost.
    """
    level = F.upper(F.coalesce(F.trim("level"), F.lit("")))
    over = F.lit(False) if most is None else F.row_number().over(Window.partitionBy("batch_id").orderBy("event_id")) > most
    reason = F.when(over, "batch_too_large").when(~level.isin(*LEVELS), "level").when(F.coalesce(F.trim("module"), F.lit("")) == "", "module")
    return batch.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).withColumn("level", level).withColumn("context", F.when(F.col("accepted"), redacted(F.col("context"))))
