"""Throttled progress: keyed state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .events import _run, source


def throttled(events: DataFrame, every: int = 10, seconds: float = 2.0) -> DataFrame:
    """Of a stream (job, at, n, chunk, total, routine) what is to be sent on: n of each event.

    Events that are no routine, the first and the last chunk and every `every`-th one always go; others only if
    `seconds` have passed since the last one that went. State is one time per job. Within a micro-batch events
    are taken in order of (at, n).
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "n"])
        sent = []
        for at, n, chunk, total, routine in zip(rows["at"], rows["n"], rows["chunk"], rows["total"], rows["routine"], strict=True):
            if not routine or chunk <= 1 or (total and chunk >= total) or chunk % every == 0 or last is None or at - last >= seconds:
                last = at
                sent.append(n)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"job": [key[0]] * len(sent), "n": sent})

    return events.groupBy("job").applyInPandasWithState(run, "job long, n long", "last double", "append", GroupStateTimeout.NoTimeout)


def progress(spark: SparkSession, path: str, every: int = 10, seconds: float = 2.0) -> DataFrame:
    """Progress events of a folder of log events, as far as they are to be sent on."""
    e = source(spark, path).selectExpr(
        "user_id as job", "unix_micros(cast(ts as timestamp)) / 1e6 as at", "event_id as n", "event_id % 37 as chunk", "36L as total", "event_type not in ('error', 'signup') as routine"
    )
    return spark.read.parquet(_run(throttled(e, every, seconds), "append")).select("job", "n")
