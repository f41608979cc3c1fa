"""Queries of write rules and queues: orders are materials or jobs, line items cards, events queue entries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import queues as Q
from ..operators import writes as W
from ..session import table
from .registry import query


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


def _cards(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("material_id"), F.concat(F.lit("gen:"), F.col("l_linenumber").cast("string")).alias("source_key")).distinct()


_CARDS = "c as (select distinct l_orderkey as material_id, 'gen:' || l_linenumber as source_key from lineitem)"


@query("dml3_downgrade_guard", "select o_orderkey, 'card-v' || (o_orderkey % 11) as version from orders where o_orderkey % 11 >= o_orderkey % 7")
def dml3(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    named = lambda n: o.withColumn("version", F.concat(F.lit("card-v"), (F.col("o_orderkey") % n).cast("string")))
    return W.guarded(named(7), named(11), "o_orderkey", "version", "card")


@query("dml5_compare_and_replace", f"""
with {_CARDS}, e as (select o_orderkey as material_id, 'gen:' || unnest(range(1, (o_orderkey % 7 + 2)::int)) as source_key from orders),
q as (select material_id, bool_and(a and b) as same from (select coalesce(c.material_id, e.material_id) as material_id, c.source_key is not null as a, e.source_key is not null as b from c full join e on c.material_id = e.material_id and c.source_key = e.source_key) group by 1)
select material_id, source_key, false as replaced from c where material_id not in (select material_id from q where same)
union all select o_orderkey, 'new:1', true from orders where o_orderkey in (select material_id from q where same)""")
def dml5(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("material_id"))
    expected = o.select("material_id", F.explode(F.sequence(F.lit(1), (F.col("material_id") % 7 + 1).cast("int"))).alias("k"))
    expected = expected.select("material_id", F.concat(F.lit("gen:"), F.col("k").cast("string")).alias("source_key"))
    return W.replace_if_same(_cards(spark, d), expected, o.withColumn("source_key", F.lit("new:1")))


@query("dml6_add_only", f"""
with {_CARDS}, a as (select material_id, source_key, 'What is ' || source_key || '?' as question from c),
o as (select * from a where source_key in ('gen:1', 'gen:2')), n as (select material_id, source_key, case when source_key in ('gen:3', 'gen:6') then 'what IS gen 1' else question end as question from a where source_key <> 'gen:2'),
f as (select *, lower(regexp_replace(question, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+', '', 'g')) as k from n where source_key <> 'gen:5' and source_key <> 'gen:1'),
g as (select * from f where not exists (select 1 from o where o.material_id = f.material_id and lower(regexp_replace(o.question, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+', '', 'g')) = f.k)),
h as (select *, row_number() over (partition by material_id, k order by source_key) as rn from g)
select material_id, source_key, question, false as added from o union all select material_id, source_key, question, true from h where rn = 1""")
def dml6(spark, d):
    key = F.col("source_key")
    cards = _cards(spark, d).withColumn("question", F.concat(F.lit("What is "), key, F.lit("?")))
    old = cards.filter(key.isin("gen:1", "gen:2"))
    new = cards.filter(key != "gen:2").withColumn("question", F.when(key.isin("gen:3", "gen:6"), "what IS gen 1").otherwise(F.col("question")))
    return W.add_only(old, new, cards.filter(key == "gen:5").select(*W.KEYS))


@query("dml7_count_refresh", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey)::bigint as n_materials from customer")
def dml7(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return W.refresh_counts(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "n_materials")


@query("dml8_exclusion", f"with {_CARDS} select material_id, source_key, source_key <> 'gen:4' and material_id not in (select o_orderkey from orders where o_orderstatus = 'P') as active from c")
def dml8(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("material_id"))
    return W.exclude(_cards(spark, d).withColumn("active", F.col("source_key") != "gen:4"), gone).select("material_id", "source_key", "active")


@query("st1_lease_claim", """
select event_id as id, (event_id % 3 + 1)::bigint as attempt from events where ts <= timestamp '2024-01-20' and (event_id % 4 = 0 or ts + interval 2 day <= timestamp '2024-01-20') order by event_id limit 50""")
def st1(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("due"), F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.make_dt_interval(days=F.lit(2))).alias("lease_until"), (F.col("event_id") % 3).alias("attempt"))
    return Q.claimable(e, _ts("2024-01-20"), 50).select("id", "attempt")


@query("st4_stale_results", """
select event_id, user_id as job_id from events join customer on c_custkey = user_id where event_id % 3 = c_custkey % 3 and c_mktsegment not in ('BUILDING', 'MACHINERY')""")
def st4(spark, d):
    results = table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), (F.col("event_id") % 3).alias("version"))
    status = F.when(F.col("c_mktsegment") == "BUILDING", "DONE").when(F.col("c_mktsegment") == "MACHINERY", "FAILED").otherwise("RUNNING")
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") % 3).alias("active_version"), status.alias("status"))
    return Q.fenced(results, jobs).select("event_id", "job_id")


@query("st5_contiguous_offsets", """
with o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events), m as (select user_id, min(k) as gap from o where value <= 10 group by 1), n as (select user_id, count(*) as n from o group by 1)
select user_id, (coalesce(gap, n) - 1)::bigint as committed from n left join m using (user_id) where coalesce(gap, n) > 0""")
def st5(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return Q.committed(table(spark, d, "events").withColumn("k", k.cast("long")).filter("value > 10"), "user_id", "k")


@query("st9_retention", """
select event_id from events where (event_type = 'click' and ts <= timestamp '2024-01-25' - interval 24 hour) or (event_type = 'error' and ts <= timestamp '2024-01-25' - interval 168 hour)""")
def st9(spark, d):
    s = F.when(F.col("event_type") == "click", "PROMOTED").when(F.col("event_type") == "error", "FAILED").otherwise("STAGED")
    return Q.past_retention(table(spark, d, "events").select("event_id", F.col("ts").alias("updated_at"), s.alias("status")), _ts("2024-01-25")).select("event_id")


@query("st12_ttl_expiry", "select event_id from events where event_type in ('click', 'view') and ts + interval 1 day <= timestamp '2024-01-10'")
def st12(spark, d):
    s = F.when(F.col("event_type") == "click", "REQUESTED").when(F.col("event_type") == "view", "RUNNING").otherwise("DONE")
    e = table(spark, d, "events").select("event_id", (F.col("ts") + F.make_dt_interval(days=F.lit(1))).alias("expires_at"), s.alias("status"))
    return Q.expired(e, _ts("2024-01-10")).select("event_id")
