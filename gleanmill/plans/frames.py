"""Frames: an embedding is the grey grid of a frame, its label the video; an event is a frame of its user's recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as V
from ..session import table
from .registry import query

_EVENTS = f"""e as (select user_id as video, event_id as frame, epoch_us(ts) // 1000000 as t, event_type as g, value >= 40 as ocr from events),
v as (select video, greatest(1, floor(n * 0.25))::bigint as most, greatest(1, ceil(span / greatest(1, n)))::bigint as width, n from (select video, count(*) filter (ocr) as n, max(t) - min(t) + 1 as span from e group by 1)),
b as (select e.*, case when n > 0 then most else 0 end as most, t // width as bucket from e join v using (video)),
f as (select *, bool_or(ocr) over (partition by video, bucket) as filled from b),
r as (select *, first(t) over w as first, coalesce(last(case when ocr then t end ignore nulls) over (w rows between unbounded preceding and 1 preceding), first(t) over w) as read, coalesce(lag(t) over w, t) as previous from f window w as (partition by video, g order by t, frame)),
d as (select *, not ocr as repeat, not filled or t - first >= {V.STAY} or t - previous >= {V.REVISIT} as always, row_number() over (partition by video, g order by t, frame) as n from r)"""


def _frames(spark, d):
    """72 grey values of a vector of 64: every row of eight and, as its ninth, the first value of the row."""
    grey = lambda c: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((c.cast("double") * 4 + 1) * 128))).cast("long")), 2, "0")
    row = lambda k: F.concat(F.slice("embedding", 8 * k + 1, 8), F.slice("embedding", 8 * k + 1, 1))
    pixels = F.unhex(F.array_join(F.transform(F.concat(*[row(k) for k in range(8)]), grey), ""))
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("video"), F.col("vec_id").alias("frame"), (F.col("vec_id") * 10).alias("time"), pixels.alias("pixels"))


@query("sf39_visual_hashes", f"""
with p as (select label::bigint as video, vec_id as frame, list_transform(embedding, lambda c: greatest(0, least(255, floor((c::double * 4 + 1) * 128)))::bigint) as p from embeddings),
h as (select video, frame, list_sum([(p[i + 1] > p[(i // 8) * 8 + (i + 1) % 8 + 1])::int::hugeint << (63 - i) for i in range(0, 64)]) as d, list_sum([(p[i + 1] * 64 >= list_sum(p))::int::hugeint << (63 - i) for i in range(0, 64)]) as a from p),
s as (select video, frame, (d - case when d >= 9223372036854775808::hugeint then 18446744073709551616::hugeint else 0 end)::bigint as dhash, (a - case when a >= 9223372036854775808::hugeint then 18446744073709551616::hugeint else 0 end)::bigint as ahash from h),
o as (select distinct video, dhash from s), n as (select x.video, x.dhash, count(*) as n from o x join o y on x.video = y.video and x.dhash <> y.dhash and bit_count(xor(x.dhash, y.dhash)) <= {V.NEAR} group by 1, 2)
select s.video, frame, s.dhash, ahash, min(frame) over (partition by s.video, s.dhash) as same, coalesce(n.n, 0)::bigint as n_near from s left join n on n.video = s.video and n.dhash = s.dhash""")
def sf39(spark, d):
    hashed = V.with_hashes(_frames(spark, d))
    near = V.near_frames(hashed)
    return near.join(hashed.select("video", "frame", "ahash"), ["video", "frame"]).select("video", "frame", "dhash", "ahash", "same", "n_near")


@query("fm14_visual_events")
def fm14(spark, d):
    return V.visual_events(_frames(spark, d))


@query("fm15_verification", f"""
with {_EVENTS},
p1 as (select video, g, min(n) as one from d where repeat and (always or t - read >= {V.VERIFY_AFTER}) group by 1, 2),
m1 as (select d.*, one, min(case when d.n = one then t end) over (partition by d.video, d.g) as one_t from d left join p1 on p1.video = d.video and p1.g = d.g),
p2 as (select video, g, min(n) as two from m1 where n > one and repeat and (always or t - greatest(read, one_t) >= {V.VERIFY_AFTER}) group by 1, 2),
m2 as (select m1.*, two from m1 left join p2 on p2.video = m1.video and p2.g = m1.g),
c as (select video, frame from (select video, frame, most, row_number() over (partition by video order by t, frame) as place from m2 where n = one or n = two) where place <= most),
x as (select m2.*, c.frame is not null as passed from m2 left join c on c.video = m2.video and c.frame = m2.frame),
y as (select *, count(*) filter (passed) over w as before, max(case when passed then t end) over w as last from x window w as (partition by video, g order by n rows between unbounded preceding and 1 preceding))
select video, frame, t as time, g as "group", case when passed then 'visual_verification' when ocr then 'new_visual' else '{V.REPEAT}' end as trigger, passed as verified,
  case when not passed and repeat and (always or t - greatest(read, coalesce(last, read)) >= {V.VERIFY_AFTER}) then case when before >= {V.VERIFY_EACH} then 'per_group_limit' else 'global_budget' end end as skipped from y""")
def fm15(spark, d):
    seen = F.expr("unix_micros(to_timestamp(ts)) div 1000000")
    primary = F.col("value") >= 40
    e = table(spark, d, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), seen.alias("time"), F.col("event_type").alias("group"), F.when(primary, "new_visual").otherwise(V.REPEAT).alias("trigger"), primary.alias("ocr"))
    return V.verified(e)
