"""Queries of order-dependent operators, chunking and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline
from ..session import table
from .registry import query


def _cues(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("cue"), (F.col("turn") * 35 + F.col("conv_id") % 7).alias("start"), (F.col("turn") * 35 + 30).alias("end"), "text")


@query("fm6_transcript_segments", """
with recursive c as (select conv_id as document_id, turn as cue, turn * 35 + conv_id % 7 as start, row_number() over (partition by conv_id order by turn) as rn from conversations),
f as (select document_id, cue, start, rn, start as first, 1 as n, 0 as segment from c where rn = 1
 union all select c.document_id, c.cue, c.start, c.rn, case when c.start - f.first >= 120 or f.n >= 6 then c.start else f.first end, case when c.start - f.first >= 120 or f.n >= 6 then 1 else f.n + 1 end,
  f.segment + case when c.start - f.first >= 120 or f.n >= 6 then 1 else 0 end from f join c on c.document_id = f.document_id and c.rn = f.rn + 1)
select document_id, cue, segment::bigint as segment from f""")
def fm6(spark, d):
    return timeline.segments(_cues(spark, d))


@query("fm7_evidence_packing", """
with recursive c as (select conv_id as document_id, turn as item, length(text) as size, row_number() over (partition by conv_id order by turn) as rn from conversations),
f as (select document_id, item, size, rn, size as total, 1 as n, 0 as batch from c where rn = 1
 union all select c.document_id, c.item, c.size, c.rn, case when f.n >= 4 or f.total + c.size > 900 then c.size else f.total + c.size end, case when f.n >= 4 or f.total + c.size > 900 then 1 else f.n + 1 end,
  f.batch + case when f.n >= 4 or f.total + c.size > 900 then 1 else 0 end from f join c on c.document_id = f.document_id and c.rn = f.rn + 1)
select document_id, item, batch::bigint as batch from f""")
def fm7(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("item"), F.length("text").alias("size"))
    return timeline.packed(c, 4, 900)


@query("jn9_interval_overlap", """
with s as (select conv_id, turn, turn * 35 - 10 as s, turn * 35 + 45 as e from conversations), f as (select event_id, user_id % 50 as conv_id, event_id % 400 as rs, event_id % 400 + 20 as re, value from events),
j as (select s.conv_id, turn, event_id, row_number() over (partition by s.conv_id, turn order by value desc, event_id) as place from s join f on f.conv_id = s.conv_id and s < re and rs < e)
select conv_id, turn, event_id, place::bigint as place from j where place <= 3""")
def jn9(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 35 - 10).alias("s"), (F.col("turn") * 35 + 45).alias("e"))
    f = table(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("conv_id"), (F.col("event_id") % 400).alias("rs"), (F.col("event_id") % 400 + 20).alias("re"), "value")
    return timeline.best_frames(timeline.overlap_join(s, f, ["conv_id"], 120), ["conv_id", "turn"], F.col("value"), "event_id").select("conv_id", "turn", "event_id", "place")


@query("set8_frame_clusters")
def set8(spark, d):
    c = _cues(spark, d).select("document_id", F.col("cue").alias("frame"), F.col("start").alias("second"), "text")
    return timeline.frame_clusters(c)


@query("fm1_recursive_chunks")
def fm1(spark, d):
    from ..operators.chunking import chunk

    return chunk(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query("fm4_window_parents", """
select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1) // 3 as parent, (turn * 35 // 60 * 60)::bigint as video_window from conversations""")
def fm4(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, d, "conversations").select("conv_id", "turn", F.floor(n / 3).cast("long").alias("parent"), (F.floor(F.col("turn") * 35 / 60) * 60).cast("long").alias("video_window"))


@query("st3_idempotent_stream", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def st3(spark, d):
    from ..streaming.events import first_by_key

    return first_by_key(spark, f"{d}/events.parquet", ["user_id", "event_type"], "event_id")


@query("st11_status_projection", "select user_id, count(*)::bigint as events, max(ts) as last_ts, arg_max(event_type, (ts, event_id)) as status from events group by 1")
def st11(spark, d):
    from ..streaming.events import status_projection

    return status_projection(spark, f"{d}/events.parquet")


@query("st_tumbling_windows_extension", """
select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2""")
def st_windows(spark, d):
    from ..streaming.events import tumbling

    return tumbling(spark, f"{d}/events.parquet", "1 hour")


@query("st13_rate_window", """
select event_id, count(*) over (partition by user_id order by ts range between interval 59 seconds preceding and current row)::bigint as starts from events""")
def st13(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-59_000_000, 0)).alias("starts"))


@query("st6_retry_ladder", """
select event_id, case when event_type = 'error' then 'dlq' when event_id % 6 = 0 then 'ok' when event_id % 6 = 1 then 'retry-1m' when event_id % 6 = 2 then 'retry-10m' when event_id % 6 = 3 then 'retry-1h' else 'dlq' end as topic from events""")
def st6(spark, d):
    from ..streaming.events import retry_topic

    attempt = F.col("event_id") % 6
    return table(spark, d, "events").select("event_id", retry_topic(attempt, F.col("event_type") == "error").alias("topic"))
