"""Queries of scores, decisions and scheduling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import schedule
from ..operators import scoring as S
from ..session import table
from .registry import query


@query("sf41_fsrs_replay")
def sf41(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("reviewed_at"), (F.col("event_id") % 4 + 1).alias("rating"))
    return schedule.replay(e, "user_id")


@query("agg23_parse_quality", r"""
with s as (select doc_id, length(text) as c, len(string_split_regex(text, '\n\s*\n')) - (doc_id % 9 = 0)::int * len(string_split_regex(text, '\n\s*\n')) as p, doc_id % 3 as m, (doc_id % 10) / 10.0::double as er, (doc_id % 7 = 0)::int as em from documents),
q as (select *, round(greatest(0, least(1, 1 - ((case when c < 80 then 0.35 else 0.0 end)::double + (case when c >= 80 and c < 300 then 0.15 else 0.0 end)::double + (case when p = 0 then 0.25 else 0.0 end)::double
  + (case when c < 120 and m >= 1 then 0.3 else 0.0 end)::double + (case when er >= 0.75 then 0.15 else 0.0 end)::double + (case when em > 0 then 0.08 else 0.0 end)::double))), 4) as score from s)
select doc_id, score, c < 120 and m >= 1 as screenshot_like, (c < 120 and m >= 1) or score < 0.68 as needs_supplement,
  ((c < 300)::int + (p = 0)::int + (c < 120 and m >= 1)::int + (er >= 0.75)::int + (em > 0)::int)::bigint as n_messages from q""")
def agg23(spark, d):
    k = F.col("doc_id")
    paragraphs = F.when(k % 9 == 0, 0).otherwise(F.size(F.split("text", r"\n\s*\n")))
    q = S.parse_quality(F.length("text"), paragraphs, F.lit(0), k % 3, (k % 10) / 10, F.when(k % 7 == 0, 1).otherwise(0))
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", q.alias("q"))
    return x.select("doc_id", "q.score", "q.screenshot_like", "q.needs_supplement", F.size("q.messages").cast("long").alias("n_messages"))


@query("agg24_match_score", """
with c as (select l_orderkey, count(*) filter (l_returnflag = 'A') as s, count(*) filter (l_returnflag = 'R') as w, count(*) as n from lineitem group by 1),
p as (select *, round_even(s * 100 / n::double, 0) as mastered, round_even(w * 100 / n::double, 0) as partial from c)
select l_orderkey, mastered::bigint as mastered, partial::bigint as partial, greatest(0, 100 - mastered - partial)::bigint as gap, least(100, mastered + round_even(partial * 0.5, 0))::bigint as score from p""")
def agg24(spark, d):
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(flag("A").alias("s"), flag("R").alias("w"), flag("N").alias("n"))
    return c.select("l_orderkey", S.match_score(F.col("s"), F.col("w"), F.col("n")).alias("m")).select("l_orderkey", "m.*")


@query("sf40_visual_decision", """
with e as (select event_id, case when event_id % 11 = 0 then null else bit_count(xor(event_id, event_id // 16)) end::int as h, case when event_id % 13 = 0 then null else event_id % 17 end as x from events)
select event_id, case when h is null then 'new_visual' when h <= 4 and x <= 2 then 'repeat_visual_confident' when x >= 12 then 'new_visual' when h <= 6 then 'ambiguous_visual' when x <= 12 then 'ambiguous_visual' else 'new_visual' end as decision from e""")
def sf40(spark, d):
    k = F.col("event_id")
    distance = F.when(k % 11 != 0, S.hamming(k, F.floor(k / 16)))
    return table(spark, d, "events").select("event_id", S.visual_decision(distance, F.when(k % 13 != 0, k % 17), same=2, flip=12).alias("decision"))


@query("sf53_least_coverage", """
with c as (select conv_id, count(*) as n, count(*) filter (text like '%e%') as m from conversations group by 1)
select conv_id, least(n, greatest(1, ceil(n * case when conv_id % 2 = 0 then 0.45 when m >= 3 and m / n::double >= 0.08 then 0.65 else 0.85 end::double)))::bigint as least_covered from c""")
def sf53(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("text").contains("e")).alias("m"))
    return c.select("conv_id", S.least_coverage(F.col("m"), F.col("n"), F.col("conv_id") % 2 == 0).alias("least_covered"))


@query("win4_run_scaling", """
with r as (select user_id, event_type, event_id, value, min(value) over w as lo, max(value) over w as hi from events window w as (partition by user_id, event_type))
select event_id, round(case when hi > lo then (value - lo) / (hi - lo) when value > 0 then 1.0 else 0.0 end, 6)::double as fused,
  round(case when hi > lo then (value - lo) / (hi - lo) else greatest(0, least(1, value)) end, 6)::double as reranked, round(case when hi > lo then (value - lo) / (hi - lo) else 1.0 end, 6)::double as guarded from r""")
def win4(spark, d):
    run = ["user_id", "event_type"]
    x = lambda tied, name: F.round(S.scaled(F.col("value"), run, tied), 6).alias(name)
    return table(spark, d, "events").select("event_id", x("one_if_positive", "fused"), x("clamp", "reranked"), x("one", "guarded"))


@query("win12_overlap_prefix", "select conv_id, turn, coalesce(right(lag(text) over (partition by conv_id order by turn), 90), '') || text as piece from conversations")
def win12(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce(F.right(before, F.lit(90)), F.lit("")), "text").alias("piece"))


@query("sf23_best_match", r"""
with t as (select conv_id, turn, lower(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}]+', '', 'g')) as t from conversations),
g as (select conv_id, turn, list_distinct(list_transform(range(1, greatest(length(t) - 1, 1) + 1), lambda i: substr(t, i, 2))) as g from t),
p as (select a.conv_id, a.turn, b.turn as source, len(list_intersect(a.g, b.g)) / greatest(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 1)::double as score from g a join g b on a.conv_id = b.conv_id and b.turn in (a.turn - 1, a.turn + 1, a.turn + 2)),
r as (select *, row_number() over w as rn, lead(score) over w as nxt from p window w as (partition by conv_id, turn order by score desc, source))
select conv_id, turn, source, round(score, 6) as score from r where rn = 1 and score >= 0.18 and (nxt is null or score > nxt)""")
def sf23(spark, d):
    c = table(spark, d, "conversations")
    near = c.select("conv_id", "turn", F.col("text").alias("q"), F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1, F.col("turn") + 2)).alias("source"))
    pairs = near.join(c.select("conv_id", F.col("turn").alias("source"), "text"), ["conv_id", "source"]).select("conv_id", "turn", "source", S.key_similarity(F.col("q"), F.col("text")).alias("score"))
    return S.best_match(pairs, ["conv_id", "turn"], "source").withColumn("score", F.round("score", 6))


@query("sf54_set_fingerprint", "select l_orderkey, sha256(string_agg(k, ',' order by k)) as fingerprint from (select distinct l_orderkey, l_partkey::varchar as k from lineitem) group by 1")
def sf54(spark, d):
    return S.set_fingerprint(table(spark, d, "lineitem"), "l_orderkey", F.col("l_partkey").cast("string"))


@query("agg12_sections", """
with g as (select conv_id, role, min(turn) as first, count(*) as n, string_agg(text, chr(10) order by turn) as t from conversations group by 1, 2)
select conv_id as document_id, role as section, (row_number() over (partition by conv_id order by first, role) - 1)::bigint as place, n::bigint as n_chunks, md5(t) as text from g""")
def agg12(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("role").alias("section"), F.col("turn").alias("position"), "text")
    return S.sections(c).withColumn("text", F.md5("text"))


@query("jn12_span_evidence", """
with p as (select conv_id, turn, length(text) as size, coalesce(sum(length(text) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as rs from conversations),
s as (select conv_id, turn as span, turn * 40 as s, turn * 40 + 90 as e from conversations)
select s.conv_id as document_id, span, turn as piece from s join p on p.conv_id = s.conv_id and s < rs + size and rs < e where size > 0""")
def jn12(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "document_id")
    spans = c.select("document_id", F.col("turn").alias("span"), (F.col("turn") * 40).alias("s"), (F.col("turn") * 40 + 90).alias("e"))
    return S.spans_to_evidence(spans, c.select("document_id", F.col("turn").alias("piece"), F.length("text").alias("size")))


@query("agg3_dashboard", """
select (select count(*) from orders)::bigint as materials, (select count(*) from orders where o_orderdate >= timestamp '1997-01-01')::bigint as recent, (select count(*) from lineitem)::bigint as chunks, (select count(*) from events where event_type = 'error')::bigint as errors""")
def agg3(spark, d):
    o = table(spark, d, "orders").agg(F.count("*").alias("materials"), F.count_if(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("recent"))
    rows = [o, table(spark, d, "lineitem").agg(F.count("*").alias("chunks")), table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"))]
    return rows[0].crossJoin(rows[1]).crossJoin(rows[2])  # three single rows


@query("agg19_metric_averages", """
with m as (select user_id % 20 as run, unnest(['value', 'root']) as metric, unnest([case when event_id % 5 = 0 then null when event_id % 7 = 0 then 'nan'::double else value end, sqrt(abs(value))]) as v from events)
select run, metric, count(v) filter (not isnan(v))::bigint as n, round(avg(v) filter (not isnan(v)), 4) as mean from m group by 1, 2""")
def agg19(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    m = table(spark, d, "events").select((F.col("user_id") % 20).alias("run"), v.alias("value"), F.sqrt(F.abs("value")).alias("root")).unpivot("run", ["value", "root"], "metric", "v")
    m = m.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return m.groupBy("run", "metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("top18_page_bounds", """
with p as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as rn, max(turn) over (partition by conv_id) as hi, min(turn) over (partition by conv_id) as lo from conversations where turn < 5)
select conv_id, min(turn) as first_turn, max(turn) as last_turn, min(turn) > min(lo) as has_before, exists(select 1 from conversations c where c.conv_id = p.conv_id and c.turn >= 5) as has_after from p where rn <= 3 group by conv_id""")
def top18(spark, d):
    w = Window.partitionBy("conv_id")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.min("turn").over(w).alias("lo"), F.max("turn").over(w).alias("hi")).filter("turn < 5")
    page = c.withColumn("rn", F.row_number().over(w.orderBy(F.desc("turn")))).filter("rn <= 3")
    return page.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), (F.min("turn") > F.min("lo")).alias("has_before"), (F.max("hi") >= 5).alias("has_after"))


@query("set17_two_stage_merge", """
with u as (select o_orderkey, 0 as stage from orders where o_orderstatus = 'F' union all select o_orderkey, 1 from orders where o_orderkey % 3 = 0)
select o_orderkey, min(stage)::int as stage from u group by 1""")
def set17(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    first, second = o.filter("o_orderstatus = 'F'"), o.filter("o_orderkey % 3 = 0")
    both = first.select("o_orderkey", F.lit(0).alias("stage")).unionByName(second.select("o_orderkey", F.lit(1).alias("stage")))
    return both.groupBy("o_orderkey").agg(F.min("stage").alias("stage"))


@query("fm3_occurrences", "select user_id, row_number() over (partition by user_id order by t)::bigint as occurrence, t as second from (select distinct user_id, date_part('hour', ts)::int * 60 as t from events)")
def fm3(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.hour("ts") * 60)).alias("times"))
    x = e.select("user_id", F.posexplode("times").alias("k", "second"))
    return x.select("user_id", (F.col("k") + 1).cast("long").alias("occurrence"), "second")
