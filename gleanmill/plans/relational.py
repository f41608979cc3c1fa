"""Queries of joins, aggregates, windows, top-k, set operations and writes as plans.

Orders stand for materials, line items for cards, customers for users, nations and regions for folders.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import review
from ..session import table
from .registry import query


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


@query("jn1_inner_join", "select c_custkey, o_orderkey, n_name from customer join orders on o_custkey = c_custkey join nation on n_nationkey = c_nationkey where o_orderstatus = 'P'")
def jn1(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "o_orderkey", "n_name")


@query("jn2_left_chain", """
select r_name, n_name, count(distinct c_custkey)::bigint as users, count(o_orderkey)::bigint as materials
from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey and o_orderstatus = 'O' group by all""")
def jn2(spark, d):
    r, n, c, o = (table(spark, d, x) for x in ("region", "nation", "customer", "orders"))
    o = o.filter("o_orderstatus = 'O'")
    j = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("users"), F.count("o_orderkey").alias("materials"))


@query("jn3_version_gate", """
select o_orderkey, coalesce(case when l.v = o_orderkey % 3 then l.n end, -1) as n_cards from orders left join
 (select l_orderkey, count(*)::bigint as n, (count(*) % 3)::bigint as v from lineitem group by 1) l on l_orderkey = o_orderkey""")
def jn3(spark, d):
    cards = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).withColumn("v", F.col("n") % 3)
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(cards, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.when(F.col("v") == F.col("o_orderkey") % 3, F.col("n")), F.lit(-1)).alias("n_cards"))


@query("jn4_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def jn4(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 250000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn5_semi_join", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 45)")
def jn5(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45")
    return table(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("jn6_scalar_join", "select c_custkey, round(c_acctbal - (select avg(c_acctbal) from customer), 2) as above from customer where c_acctbal > (select avg(c_acctbal) from customer)")
def jn6(spark, d):
    c = table(spark, d, "customer")
    one = F.broadcast(c.agg(F.avg("c_acctbal").alias("mean")))  # a single row
    return c.join(one, F.col("c_acctbal") > F.col("mean")).select("c_custkey", F.round(F.col("c_acctbal") - F.col("mean"), 2).alias("above"))


@query("jn7_reorder", """
with i as (select o_custkey as owner, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as old from orders),
q as (select owner, list(o_orderkey order by o_orderkey desc)[1:2] as ids from i group by 1),
a as (select owner, unnest(ids) as o_orderkey, unnest(range(len(ids))) as pos from q)
select owner, o_orderkey, old::bigint as old, (row_number() over (partition by owner order by pos nulls last, old, o_orderkey) - 1)::bigint as new from i left join a using (owner, o_orderkey)""")
def jn7(spark, d):
    o = table(spark, d, "orders")
    items = o.select(F.col("o_custkey").alias("owner"), "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("position"))
    asked = items.groupBy("owner").agg(F.slice(F.sort_array(F.collect_list("o_orderkey"), asc=False), 1, 2).alias("ids"))
    return review.reorder(items, asked, "o_orderkey", "position")


@query("jn13_neighbours", """
with h as (select conv_id, turn from conversations where contains(text, 'www') or turn % 5 = 2)
select distinct c.conv_id, c.turn from conversations c join h on h.conv_id = c.conv_id and c.turn between h.turn - 1 and h.turn + 1""")
def jn13(spark, d):
    c = table(spark, d, "conversations")
    hits = c.filter(F.col("text").contains("www") | (F.col("turn") % 5 == 2)).select("conv_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    return c.join(hits, ["conv_id", "turn"], "left_semi").select("conv_id", "turn")


@query("agg1_count_sum_latest", """
select o_custkey, count(*)::bigint as n, coalesce(sum(o_totalprice), 0) as total, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as latest from orders group by 1""")
def agg1(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("agg2_since_counters", """
select count(*)::bigint as total, count(*) filter (ts >= timestamp '2024-01-15')::bigint as recent, count(*) filter (event_type = 'click')::bigint as clicks,
 count(*) filter (event_type = 'error' or value < 0)::bigint as errors, count(distinct user_id)::bigint as users from events""")
def agg2(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= _ts("2024-01-15")).alias("recent"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if((F.col("event_type") == "error") | (F.col("value") < 0)).alias("errors"), F.countDistinct("user_id").alias("users"))


@query("agg4_conditional_distinct", """
select l_suppkey, count(*) filter (l_returnflag = 'R')::bigint as returned, count(distinct l_partkey) filter (l_returnflag = 'R')::bigint as parts, min(l_shipdate) filter (l_linestatus = 'O') as next_due from lineitem group by 1""")
def agg4(spark, d):
    r = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(r).alias("returned"), F.countDistinct(F.when(r, F.col("l_partkey"))).alias("parts"), F.min(F.when(F.col("l_linestatus") == "O", F.col("l_shipdate"))).alias("next_due"))


@query("agg5_reviewed_still_due", """
with r as (select distinct l_orderkey from lineitem where l_returnflag = 'A'), u as (select distinct l_orderkey from lineitem where l_linestatus = 'O')
select count(*)::bigint as reviewed, count(u.l_orderkey)::bigint as still_due from r left join u using (l_orderkey)""")
def agg5(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("r"), F.bool_or(F.col("l_linestatus") == "O").alias("u"))
    return li.agg(F.count_if("r").alias("reviewed"), F.count_if(F.col("r") & F.col("u")).alias("still_due"))


@query("agg6_folder_rollup", """
select n_name, count(distinct o_orderkey)::bigint as materials, count(distinct o_orderkey) filter (l_returnflag = 'R')::bigint as with_due, count(distinct c_custkey) filter (c_acctbal < 0)::bigint as in_debt
from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1""")
def agg6(spark, d):
    n, c, o, li = (table(spark, d, x) for x in ("nation", "customer", "orders", "lineitem"))
    due = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("due"))
    j = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o.join(due, "o_orderkey", "left"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("materials"), F.countDistinct(F.when(F.col("due"), F.col("o_orderkey"))).alias("with_due"), F.countDistinct(F.when(F.col("c_acctbal") < 0, F.col("c_custkey"))).alias("in_debt"))


@query("agg7_bool_or_min", "select l_orderkey, bool_or(l_returnflag = 'R') as started, min(l_shipdate) as due from lineitem group by 1")
def agg7(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("started"), F.min("l_shipdate").alias("due"))


@query("agg8_append_sequence", """
with old as (select user_id, event_type, ts, event_id from events where ts < timestamp '2024-01-10'), e as (select user_id, event_type as k, count(*)::bigint as c from old group by all),
o as (select user_id, k, row_number() over (partition by user_id order by k)::bigint as sequence_no from e),
n as (select user_id, event_type as k, min(event_id) as event_id from events where ts >= timestamp '2024-01-10' group by all)
select n.user_id, n.k, n.event_id, (row_number() over (partition by n.user_id order by n.event_id) + coalesce((select max(sequence_no) from o where o.user_id = n.user_id), 0))::bigint as sequence_no
from n where not exists (select 1 from o where o.user_id = n.user_id and o.k = n.k)""")
def agg8(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("k"), "event_id", "ts")
    old = e.filter(F.col("ts") < _ts("2024-01-10")).select("user_id", "k").distinct()
    old = old.withColumn("sequence_no", F.row_number().over(Window.partitionBy("user_id").orderBy("k")).cast("long"))
    return review.append_sequence(old, e.filter(F.col("ts") >= _ts("2024-01-10")).drop("ts"), "user_id", "k", "event_id").select("user_id", "k", "event_id", "sequence_no")


@query("agg16_fingerprints", """
select sha256(concat_ws('|', 'java', case when user_id % 2 = 0 then 'rag' else 'system' end, 'unknown', event_type, 'UNKNOWN', regexp_replace(coalesce(props, '') || ' ' || (1000 + event_id), '\\d{4,}', '{num}', 'g'), 'at m' || user_id % 3)) as fingerprint,
  count(*)::bigint as occurrences, min(ts) as first_seen, max(ts) as last_seen, arg_min(event_id, (ts, event_id)) as sample from events group by 1""")
def agg16(spark, d):
    from ..functions import text as T
    from ..operators.logs import fingerprints

    message = T.masked_variables(F.concat(F.coalesce("props", F.lit("")), F.lit(" "), (1000 + F.col("event_id")).cast("string")))
    frame = T.top_frame(F.concat(F.lit("boom\nat m"), F.col("user_id") % 3, F.lit("\nat z")), "gleanmill")
    key = F.concat_ws("|", F.lit("java"), F.when(F.col("user_id") % 2 == 0, "rag").otherwise("system"), F.lit("unknown"), "event_type", F.lit("UNKNOWN"), message, frame)
    return fingerprints(table(spark, d, "events"), key, "ts", "event_id")


@query("agg20_percentiles", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def agg20(spark, d):
    from ..operators.evaluation import percentiles

    return percentiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("agg21_ab_summary", """
with a as (select user_id % 2 as arm, value from events)
select round(sum(value) filter (arm = 0), 2) as total_a, round(sum(value) filter (arm = 1), 2) as total_b, round(100 * (1 - sum(value) filter (arm = 1) / sum(value) filter (arm = 0)), 4) as reduction from a""")
def agg21(spark, d):
    e = table(spark, d, "events")
    a, b = (F.sum(F.when(F.col("user_id") % 2 == k, F.col("value"))) for k in (0, 1))
    return e.agg(F.round(a, 2).alias("total_a"), F.round(b, 2).alias("total_b"), F.round(100 * (1 - b / a), 4).alias("reduction"))


@query("agg26_dataset_validation", """
select count(*)::bigint as n, (count(*) - count(distinct doc_id))::bigint as repeated_ids, count(*) filter (text is null or text = '')::bigint as missing, count(*) filter (contains(text, '###'))::bigint as polluted, min(length(text))::bigint as least, round(avg(length(text)), 4) as mean from documents""")
def agg26(spark, d):
    t = table(spark, d, "documents")
    return t.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("doc_id")).alias("repeated_ids"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("missing"), F.count_if(F.col("text").contains("###")).alias("polluted"), F.min(F.length("text")).cast("long").alias("least"), F.round(F.avg(F.length("text")), 4).alias("mean"))


@query("agg28_card_library", """
select coalesce(l_orderkey, -1) as material, count(*)::bigint as cards, count(*) filter (l_returnflag <> 'N')::bigint as reviewed from lineitem group by grouping sets ((l_orderkey), ())""")
def agg28(spark, d):
    li = table(spark, d, "lineitem")
    return li.rollup("l_orderkey").agg(F.count("*").alias("cards"), F.count_if(F.col("l_returnflag") != "N").alias("reviewed")).select(F.coalesce("l_orderkey", F.lit(-1)).alias("material"), "cards", "reviewed")


@query("win1_group_due", "select l_orderkey, l_linenumber, min(l_shipdate) over (partition by l_orderkey) as group_due from lineitem")
def win1(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.min("l_shipdate").over(Window.partitionBy("l_orderkey")).alias("group_due"))


@query("win2_due_groups", """
with due as (select l_orderkey as material_id, min(l_shipdate) as group_due, count(*)::bigint as n_due from lineitem where l_shipdate <= timestamp '1996-01-01' group by 1),
m as (select o_orderkey as material_id, o_custkey as user_id, case when o_orderkey % 4 = 0 then null else o_orderkey % 17 end as position from orders),
b as (select distinct l_orderkey as material_id, true as begun from lineitem where l_quantity > 48),
g as (select *, coalesce(begun, false) as bg from due join m using (material_id) left join b using (material_id)),
r as (select *, count(*) filter (bg) over (partition by user_id) as started, row_number() over (partition by user_id, bg order by position nulls last, group_due, material_id) as rank from g)
select user_id, material_id, bg as begun, group_due, n_due, rank::bigint as rank from r where bg or rank <= greatest(0, 5 - started)""")
def win2(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    cards = li.select(F.col("l_linenumber").alias("card_id"), F.col("l_orderkey").alias("material_id"), F.col("l_shipdate").alias("due"))
    materials = o.select(F.col("o_orderkey").alias("material_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 17).alias("position"))
    return review.due_groups(cards, materials, li.filter("l_quantity > 48").select(F.col("l_orderkey").alias("material_id")), _ts("1996-01-01"), 5)


@query("win7_token_budget", """
with t as (select conv_id, turn, ((length(text) + 1) // 2)::bigint as tokens from conversations),
s as (select *, sum(tokens) over (partition by conv_id order by turn desc) as suffix, row_number() over (partition by conv_id order by turn desc) as rn from t)
select conv_id, turn, tokens, suffix::bigint as suffix_tokens from s where suffix <= 300 or rn = 1""")
def win7(spark, d):
    from ..functions.text import token_estimate
    from ..operators.memory import newest_within

    c = table(spark, d, "conversations").select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"))
    return newest_within(c, "conv_id", "turn", "tokens", 300)


@query("win8_after_covered", """
select conv_id, turn from (select conv_id, turn, max(case when role = 'assistant' and turn < 4 then turn end) over (partition by conv_id) as covered from conversations) where covered is null or turn > covered""")
def win8(spark, d):
    covered = F.max(F.when((F.col("role") == "assistant") & (F.col("turn") < 4), F.col("turn"))).over(Window.partitionBy("conv_id"))
    return table(spark, d, "conversations").select("conv_id", "turn", covered.alias("covered")).filter("covered is null or turn > covered").select("conv_id", "turn")


@query("win9_carry_section", """
select conv_id, turn, last_value(case when role = 'user' then left(text, 20) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as section from conversations""")
def win9(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.left("text", F.lit(20))), ignorenulls=True).over(w).alias("section"))


@query("win11_drop_repeats", "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) where p is distinct from event_type")
def win11(spark, d):
    p = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("p", p).filter(~F.col("p").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("win14_latest_per_phase", "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts from events group by 1, 2")
def win14(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("win15_last_events", "select user_id, event_id, rn from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc)::bigint as rn from events) where rn <= 12")
def win15(spark, d):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").select("user_id", "event_id", rn.cast("long").alias("rn")).filter("rn <= 12")


@query("top7_class_order", """
select p_partkey, class from (select p_partkey, case when p_size < 10 then 0 when p_size < 25 then 1 else 2 end as class, p_retailprice from part) order by class, p_retailprice desc, p_partkey limit 50""")
def top7(spark, d):
    c = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 25, 1).otherwise(2)
    return table(spark, d, "part").select("p_partkey", c.alias("class"), "p_retailprice").orderBy("class", F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "class")


@query("top9_keyset_page", "select conv_id, turn, role from conversations where (conv_id, turn) < (40, 3) order by conv_id desc, turn desc limit 25")
def top9(spark, d):
    before = (F.col("conv_id") < 40) | ((F.col("conv_id") == 40) & (F.col("turn") < 3))
    return table(spark, d, "conversations").filter(before).orderBy(F.desc("conv_id"), F.desc("turn")).limit(25).select("conv_id", "turn", "role")


@query("top10_even_sample", """
with n as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events),
k as (select unnest(range(5)) as j)
select distinct user_id, event_id from n, k where (n <= 5) or i = round_even(j * (n - 1) / 4.0, 0)""")
def top10(spark, d):
    from ..operators.sampling import evenly_spaced

    return evenly_spaced(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("top12_round_robin", """
with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as rn, min(p_partkey) over (partition by p_brand) as seen from part)
select p_partkey, p_brand, rn::bigint as turn from r order by rn, seen, p_partkey limit 60""")
def top12(spark, d):
    from ..operators.sampling import round_robin

    return round_robin(table(spark, d, "part"), "p_brand", "p_partkey").orderBy("turn", "seen", "p_partkey").limit(60).select("p_partkey", "p_brand", "turn")


@query("set1_union_all", "select o_orderkey as id, 'started' as kind from orders where o_orderstatus = 'F' union all select o_orderkey, 'new' from orders where o_orderstatus = 'O'")
def set1(spark, d):
    o = table(spark, d, "orders")
    pick = lambda s, k: o.filter(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("id"), F.lit(k).alias("kind"))
    return pick("F", "started").unionByName(pick("O", "new"))


@query("set2_distinct", "select distinct l_orderkey, l_returnflag from lineitem")
def set2(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag").distinct()


@query("set4_signature_dedupe", """
with s as (select doc_id, lang, source, left(text, 180) as head, row_number() over (partition by lang, left(text, 180) order by doc_id) as rn from documents)
select doc_id, lang, 'b' || lpad(row_number() over (partition by lang order by doc_id)::varchar, 6, '0') as block_id from s where rn = 1""")
def set4(spark, d):
    t = table(spark, d, "documents").select("lang", F.substring("text", 1, 180).alias("head"), "doc_id").groupBy("lang", "head").agg(F.min("doc_id").alias("doc_id"))
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).cast("string")
    return t.select("doc_id", "lang", F.concat(F.lit("b"), F.lpad(n, 6, "0")).alias("block_id"))


@query("set7_exact_dedupe", "select lower(regexp_replace(text, '[^\\p{L}\\p{M}\\p{Nd}]+', '', 'g')) as k, min(doc_id) as first_id, count(*)::bigint as copies from documents group by 1 having count(*) > 1")
def set7(spark, d):
    from ..functions.text import dedupe_key

    return table(spark, d, "documents").groupBy(dedupe_key(F.col("text")).alias("k")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query("set13_idempotent_insert", """
with i as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events where ts >= timestamp '2024-01-05')
select event_id, user_id, event_type from i where rn = 1 and not exists (select 1 from events e where e.ts < timestamp '2024-01-05' and e.user_id = i.user_id and e.event_type = i.event_type)""")
def set13(spark, d):
    from ..operators.logs import insert_new

    e = table(spark, d, "events")
    return insert_new(e.filter(F.col("ts") < _ts("2024-01-05")), e.filter(F.col("ts") >= _ts("2024-01-05")), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("dml1_upsert_by_source", """
with li as (select l_orderkey, l_linenumber, max(l_returnflag) as l_returnflag, max(l_linestatus) as l_linestatus, max(l_quantity) as l_quantity, max(l_partkey) as l_partkey from lineitem group by 1, 2),
old as (select l_orderkey as material_id, (case when l_linenumber = 7 then 'manual:' else 'gen:' end) || l_linenumber as source_key, l_returnflag as text, l_quantity::int as reps, true as active from li where l_linenumber <> 2),
new as (select l_orderkey as material_id, 'gen:' || l_linenumber as source_key, l_linestatus as text from li where l_linenumber in (1, 2, 3) and l_partkey % 5 <> 0)
select coalesce(o.material_id, n.material_id) as material_id, coalesce(o.source_key, n.source_key) as source_key, coalesce(n.text, o.text) as text, coalesce(o.reps, 0) as reps,
 case when n.text is not null then true when o.source_key like 'manual:%' then o.active else false end as active
from old o full join new n on o.material_id = n.material_id and o.source_key = n.source_key""")
def dml1(spark, d):
    names = ("l_returnflag", "l_linestatus", "l_quantity", "l_partkey")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in names])
    key = lambda p: F.concat(p, F.col("l_linenumber").cast("string")).alias("source_key")
    m = F.col("l_orderkey").alias("material_id")
    old = li.filter("l_linenumber <> 2").select(m, key(F.when(F.col("l_linenumber") == 7, "manual:").otherwise("gen:")), F.col("l_returnflag").alias("text"), F.col("l_quantity").cast("int").alias("reps"), F.lit(True).alias("active"))
    made = li.filter("l_linenumber in (1, 2, 3)")
    new = made.select(m, key(F.lit("gen:")), F.col("l_linestatus").alias("text"))
    return review.upsert_by_source(old, new, made.filter("l_partkey % 5 = 0").select(m, key(F.lit("gen:"))))


@query("dml2_latest_version", "select l_orderkey, max(l_linenumber) as l_linenumber, arg_max(l_partkey, (l_linenumber, l_partkey)) as l_partkey from lineitem group by 1")
def dml2(spark, d):
    return review.latest_version(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")


@query("dml4_grade_replay", "select l_partkey, count(*)::bigint as reviews, count(*) filter (l_returnflag = 'R')::bigint as lapses, max(l_shipdate) as last_reviewed from lineitem group by 1")
def dml4(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("reviews"), F.count_if(F.col("l_returnflag") == "R").alias("lapses"), F.max("l_shipdate").alias("last_reviewed"))


@query("sf11_due_quota", "select o_orderkey, (s + least(greatest(0, r), greatest(0, least(greatest(q, 1), 100) - s)))::bigint as quota from (select o_orderkey, o_orderkey % 7 as s, o_orderkey % 13 - 3 as r, o_orderkey % 120 as q from orders)")
def sf11(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", review.quota(k % 7, k % 13 - 3, k % 120).cast("long").alias("quota"))
