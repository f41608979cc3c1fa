"""Queries of agent memory: orders stand for memory items, conversations for tasks with their messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, memory
from ..session import table
from .registry import query


@query("flt5_tenant_scope", "select doc_id, lang from documents where lang in ('en', 'de') and doc_id % 7 = 3 and doc_id % 5 <> 0")
def flt5(spark, d):
    docs = table(spark, d, "documents").withColumn("userId", (F.col("doc_id") % 7).cast("string")).withColumn("visibilityScope", F.when(F.col("doc_id") % 5 == 0, "public").otherwise("private"))
    asked = {"lang": [" en", "de", ""], "userId": "5", "visibilityScope": "public", "unknown": "x"}
    return docs.filter(filters.matches(filters.tenant_scope(asked, "3", {"lang", "source", "userId"}), {"lang"}, {"userId", "visibilityScope"})).select("doc_id", "lang")


@query("flt6_visible_memory", """
select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderkey % 11 <> 0 and (o_orderkey % 3 = 0 or o_orderdate > timestamp '1995-06-01') and o_orderpriority <> '1-URGENT' and o_orderkey % 2 = 0
  and ((o_orderkey % 5 = 0 and o_orderkey % 4 = 0) or (o_orderkey % 5 = 1 and o_orderkey % 4 = 2))""")
def flt6(spark, d):
    k = F.col("o_orderkey")
    items = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "ACTIVE").otherwise("OLD").alias("status"), F.when(k % 11 == 0, F.col("o_orderdate")).alias("deleted_at"), F.when(k % 3 != 0, F.col("o_orderdate")).alias("valid_until"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").when(F.col("o_orderpriority") == "2-HIGH", "MEDIUM").alias("sensitivity_level"), F.when(k % 2 == 0, "study").otherwise("work").alias("namespace"),
        F.when(k % 5 == 0, "USER").when(k % 5 == 1, "TASK").otherwise("SESSION").alias("scope_type"), F.when(k % 4 != 0, (k % 4).cast("string")).alias("scope_id"),
    )
    now = F.lit("1995-06-01").cast("timestamp_ntz")
    return items.filter(filters.visible(now, namespaces=["study"], scopes=[("USER", None), ("TASK", "2"), ("TASK", None)])).select("o_orderkey", "o_custkey")


@query("top6_memory_order", """
with s as (select user_id, event_id, round(0.40 * least(1.0, value / 5000 * 20) + 0.20 * (event_id % 10) / 10.0 + 0.15 * exp(-greatest(epoch(timestamp '2024-02-01' - ts) / 86400.0, 0) / 30.0) + 0.15 * (event_id % 7) / 7.0
  + 0.10 * case event_type when 'click' then 1.0 when 'view' then 0.55 when 'error' then 0.35 else 0.4 end - (event_id % 20) * 1e-4, 9) as score from events),
r as (select *, row_number() over (partition by user_id order by score desc, event_id) as rank from s) select user_id, event_id, round(score, 6) as score, rank::bigint as rank from r where rank <= 8""")
def top6(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    days = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6
    scope = F.when(F.col("event_type") == "click", "TASK").when(F.col("event_type") == "view", "USER").when(F.col("event_type") == "error", "SYSTEM").otherwise("OTHER")
    score = memory.memory_score(F.least(F.lit(1.0), F.col("value") / 5000 * 20), F.col("event_id") % 10 / 10.0, days, F.col("event_id") % 7 / 7.0, scope, F.col("event_id") % 20)
    s = e.select("user_id", "event_id", F.round(score, 9).alias("score"))
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id"))).filter("rank <= 8")
    return ranked.select("user_id", "event_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("set12_memory_dedupe", """
with k as (select conv_id, turn, case when turn % 3 = 0 then role || length(text) // 100 else sha256(text) end as k from conversations where text is not null)
select conv_id, turn from (select *, row_number() over (partition by k order by conv_id, turn) as n from k) where n = 1""")
def set12(spark, d):
    given = F.when(F.col("turn") % 3 == 0, F.concat("role", F.floor(F.length("text") / 100).cast("string")))
    c = table(spark, d, "conversations").filter("text is not null").withColumn("source_hash", given)
    return memory.first_of_hash(c, ["conv_id", "turn"], "source_hash", "text").select("conv_id", "turn")


@query("sf47_memory_relation", """
with c as (select conv_id * 1000 + turn as candidate_id, role, conv_id, turn, trim(text) as t from conversations where text is not null),
m as (select a.candidate_id, b.turn, case when a.t = b.t then 'DUPLICATES' when ((contains(b.t, 'tion') or contains(b.t, 'lich')) and (contains(a.t, 'thor') or contains(a.t, 'ción'))) or ((contains(a.t, 'tion') or contains(a.t, 'lich')) and (contains(b.t, 'thor') or contains(b.t, 'ción'))) then 'CONFLICTS_WITH' end as kind
  from c a join c b on a.conv_id = b.conv_id and a.role = b.role and b.turn < 2), f as (select candidate_id, arg_min(kind, turn) as kind from m where kind is not null group by 1)
select candidate_id, coalesce(kind, 'REFINES') as relation from c left join f using (candidate_id)""")
def sf47(spark, d):
    c = table(spark, d, "conversations").filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("candidate_id"), F.col("role").alias("namespace"), F.col("conv_id").alias("subject"), F.col("text").alias("content"), F.col("turn").alias("place"))
    return memory.relations(c.drop("place"), c.filter("place < 2"), ("tion", "lich"), ("thor", "ción"))


@query("top17_summary_for_goal", r"""
with g as (select conv_id * 1000 + turn as goal_id, conv_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 2)[:12] as terms from conversations where role = 'user'),
s as (select conv_id, turn, lower(text) as t from conversations where role = 'assistant')
select goal_id, coalesce(min(case when len(list_filter(terms, lambda w: contains(t, w))) > 0 then turn end), min(turn)) as place from g join s using (conv_id) group by 1""")
def top17(spark, d):
    c = table(spark, d, "conversations")
    goals = c.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("goal_id"), F.col("conv_id").alias("task_id"), F.col("text").alias("goal"))
    return memory.summary_for(goals, c.filter("role = 'assistant'").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("place"), "text"))


@query("st16_message_append", """
with old as (select conv_id, 'k' || turn as k, turn + 1 as n from conversations where turn < 2), l as (select conv_id, max(n) as last from old group by 1),
new as (select conv_id, 'k' || turn // 2 * 2 as k, min(turn) as turn from conversations group by 1, 2), f as (select new.* from new anti join old on new.conv_id = old.conv_id and new.k = old.k)
select conv_id as task_id, k as dedupe_key, coalesce(last, 0) + row_number() over (partition by conv_id order by turn) as sequence_no from f left join l using (conv_id)""")
def st16(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), "turn")
    old = c.filter("turn < 2").select("task_id", F.concat(F.lit("k"), "turn").alias("dedupe_key"), (F.col("turn") + 1).alias("sequence_no"))
    new = c.select("task_id", F.concat(F.lit("k"), (F.floor(F.col("turn") / 2) * 2).cast("string")).alias("dedupe_key"), F.col("turn").alias("place"))
    return memory.append_messages(old, new).select("task_id", "dedupe_key", "sequence_no")
