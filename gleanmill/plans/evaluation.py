"""Queries of evaluation gates, edit similarity, log intake, and of the chunk index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as V
from ..operators import index, logs, timeline
from ..session import new_folder, table
from .registry import query


@query("agg18_offline_gate", """
with c as (select *, case when item_id % 7 = 0 then 'manual_boundary' else 'ragas' end as t, length(text) as n from benchmark)
select count(*) filter (t = 'ragas') as main_case_count, count(*) filter (t <> 'ragas') as boundary_case_count, count(*) filter (t = 'ragas' and n % 3 = 0) as top1_hit_count, count(*) filter (t = 'ragas' and n % 9 > 0) as top3_hit_count,
  count(*) filter (t = 'ragas' and n % 50 > 0) as evidence_reference_ok_count, count(*) filter (t = 'ragas' and n % 4 = 0) as empty_evidence_main_count, count(*) filter (t <> 'ragas' and n % 2 = 0) as boundary_passed_count,
  round_even(avg(case when t = 'ragas' and n % 5 > 0 then 1 / (n % 5)::double end), 6) as reciprocal_rank, round_even(avg(case when t = 'ragas' then (n % 11) / 10.0::double end), 6) as recall_at_5,
  round_even(coalesce(sum(case when t = 'ragas' then (n % 8) / 8.0::double end), 0) / greatest(count(*) filter (t = 'ragas'), 1), 4) as average_answer_point_coverage,
  count(*) filter (t = 'ragas' and n % 9 > 0) >= ceil(count(*) filter (t = 'ragas') * 0.9) and count(*) filter (t = 'ragas' and n % 50 > 0) = count(*) filter (t = 'ragas') and count(*) filter (t <> 'ragas' and n % 2 = 0) = count(*) filter (t <> 'ragas') and count(*) filter (t = 'ragas' and n % 4 = 0) <= 2 as offline_passed from c""")
def agg18(spark, d):
    n, k = F.length("text"), F.col("item_id")
    cases = table(spark, d, "benchmark").select(
        F.when(k % 7 == 0, "manual_boundary").otherwise("ragas").alias("case_type"), (n % 3 == 0).alias("top1_hit"), (n % 9 > 0).alias("top3_hit"), (n % 50 > 0).alias("evidence_reference_ok"), (n % 4).alias("evidence_count"), (n % 2 == 0).alias("boundary_passed"),
        (n % 8 / 8.0).alias("answer_point_coverage"), F.when(n % 5 > 0, 1 / (n % 5)).alias("reciprocal_rank"), (n % 11 / 10.0).alias("recall_at_5"),
    )
    return V.gate(cases)


@query("agg22_arm_decision", f"""
with x as (select avg(c_custkey % 10 / 20.0::double) as ra, avg(c_custkey % 10 / 12.0::double) as rb, sum(c_nationkey * 10)::bigint as ta, sum(c_nationkey * 14)::bigint as tb, bool_or(c_custkey % 1000 = 999) as o, bool_or(0.94 + c_custkey % 7 / 100.0::double < 0.95) as m, bool_or(c_custkey % 3 / 10.0 > 0.1) as dup from customer)
select false as enable, round_even(ra, 6) as recall_a, round_even(rb, 6) as recall_b, ta as tokens_a, tb as tokens_b,
  array_to_string(list_filter([case when o then '{V.REASONS[0]}' end, case when rb - ra < 0.1 then '{V.REASONS[1]}' end, case when m then '{V.REASONS[2]}' end, case when dup then '{V.REASONS[4]}' end, case when tb > 1.5 * ta then '{V.REASONS[5]}' end], lambda r: r is not null), '|') as reasons from x""")
def agg22(spark, d):
    k = F.col("c_custkey")
    arm = lambda status, recall, mapped, dup, tokens: F.struct(status.alias("status"), recall.alias("recall"), mapped.alias("mapped"), F.lit(0.0).alias("ungrounded"), dup.alias("duplicates"), tokens.alias("tokens"))
    a = arm(F.when(k % 1000 == 999, "FAILED").otherwise("COMPLETED"), k % 10 / 20.0, F.lit(1.0), F.lit(0.1), F.col("c_nationkey").cast("long") * 10)
    b = arm(F.lit("COMPLETED"), k % 10 / 12.0, 0.94 + k % 7 / 100.0, k % 3 / 10.0, F.col("c_nationkey").cast("long") * 14)
    cases = table(spark, d, "customer").select(F.when(k % 2 == 0, "structured_questions").otherwise("declarative_course").alias("category"), a.alias("a"), b.alias("b"))
    return V.decision(cases).withColumn("reasons", F.array_join("reasons", "|"))


@query("set10_question_duplicates")
def set10(spark, d):
    """Of each user turn and the next one, whether they are one question. The ratio has no SQL; held against the rule in Python in the tests."""
    return _adjacent(spark, d).select("conv_id", "turn", V.same_question(F.col("a"), F.col("b")).alias("same"))


@query("set11_near_texts")
def set11(spark, d):
    keyed = _adjacent(spark, d).select("conv_id", "turn", T.dedupe_key(F.col("a")).alias("a"), T.dedupe_key(F.col("b")).alias("b")).filter("a <> '' and b <> ''")
    return keyed.select("conv_id", "turn", V.near_texts(F.col("a"), F.col("b")).alias("near"))


@query("sf44_safe_correction")
def sf44(spark, d):
    c = table(spark, d, "conversations").filter("text is not null").withColumn("after", F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 40)).when(F.col("turn") % 3 == 1, F.reverse("text")).otherwise(F.regexp_replace("text", "e", "a")))
    dealt = c.repartition(4 * spark.sparkContext.defaultParallelism)  # a small file is one task, and texts take long
    return dealt.select("conv_id", "turn", V.safe_correction(F.col("text"), F.col("after")).alias("safe"))


def _adjacent(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user' and text is not null").select("conv_id", "turn", "text")
    return c.withColumnRenamed("text", "a").join(c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])


@query("jn10_repeated_cues", r"""
with recursive c as (select conv_id as document_id, turn * 3.0::double as start, turn * 3.0::double + 3 as "end", text from conversations where text is not null),
a as (select * from c union all select document_id, start + 1.5, "end", substr(text, 5) from c where start % 2 = 0),
o as (select *, lower(trim(text, E' \\t\\n\\r')) as said, row_number() over (partition by document_id order by start, "end", text) as rn from a),
f as (select document_id, rn, true as keep, [{'start': start, 'said': said}] as last from o where rn = 1
 union all select document_id, rn, keep, case when keep then list_append(last, {'start': start, 'said': said})[-6:] else last end from
  (select o.*, f.last, said = '' or len(list_filter(f.last, lambda k: k.said <> '' and abs(k.start - o.start) <= 2 and (contains(k.said, o.said) or contains(o.said, k.said)))) = 0 as keep from f join o on o.document_id = f.document_id and o.rn = f.rn + 1))
select document_id, row_number() over (partition by document_id order by rn)::int as cue, start, greatest(start + 0.2, "end") as "end", text from f join o using (document_id, rn) where keep""")
def jn10(spark, d):
    """Cues of two recordings that overlap: every turn's whole text, and of every other turn a second cue that lacks its start."""
    c = table(spark, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("document_id"), (F.col("turn") * 3.0).alias("start"), (F.col("turn") * 3.0 + 3).alias("end"), "text")
    again = c.filter(F.col("start") % 2 == 0).withColumn("start", F.col("start") + 1.5).withColumn("text", F.expr("substring(text, 5)"))
    return timeline.merged_cues(c.unionByName(again))


_CONTEXT = """'{"k":' || user_id || ',"auth":{"access_token":"t' || event_id || '","note":"' || event_type || '"},"list":[1,"x"],"Question":"secret"}'"""


@query("sf19_redaction", """select event_id, '{"k":' || user_id || ',"auth":{"access_token":"***","note":"' || event_type || '"},"list":[1,"x"],"Question":"***"}' as context from events""")
def sf19(spark, d):
    return table(spark, d, "events").select("event_id", logs.redacted(F.expr(_CONTEXT)).alias("context"))


@query("st15_log_intake", """
with e as (select *, case event_type when 'error' then 'ERROR' when 'view' then 'INFO' when 'click' then 'DEBUG' else upper(event_type) end as level, case when user_id % 9 = 0 then '' else 'm' || user_id % 4 end as module from events),
r as (select *, case when level not in ('DEBUG', 'INFO', 'WARN', 'ERROR') then 'level' when module = '' then 'module' end as reason from e)
select module, level, reason, count(*) as n, coalesce(sum(length('{"k":' || user_id || ',"access_token":"***"}')) filter (reason is null), 0)::bigint as size from r group by 1, 2, 3""")
def st15(spark, d):
    level = F.when(F.col("event_type") == "error", " error").when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "Debug").otherwise(F.col("event_type"))
    module = F.when(F.col("user_id") % 9 == 0, "").otherwise(F.concat(F.lit("m"), F.col("user_id") % 4))
    e = table(spark, d, "events").select("event_id", level.alias("level"), module.alias("module"), F.expr("""'{"k":' || user_id || ',"access_token":"abc"}'""").alias("context"))
    return logs.ingest(e).groupBy("module", "level", "reason").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("context")), F.lit(0)).alias("size"))


def _blocks(spark, d):
    kind = F.when(F.col("turn") % 5 == 0, "heading").when(F.col("turn") % 5 == 1, "table").otherwise("text")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("place"), kind.alias("block_type"), F.when(F.col("turn") % 7 == 3, F.concat(F.lit("s"), "turn")).alias("section_title"), "text")


@query("fm2_block_chunks")
def fm2(spark, d):
    """Splitting by separators has no plain SQL; hand cases and bounds are in the tests."""
    return index.block_chunks(_blocks(spark, d)).select("document_id", "position", "chunk_id", "section", "block_type", F.md5("text").alias("h"))


@query("fm5_parent_summaries", r"""
with c as (select conv_id, turn, turn // 3 as p, trim(text) as t, text from conversations where turn % 7 <> 6 and text is not null),
g as (select conv_id, p, min(turn) as first, count(*) as n, trim(regexp_replace(coalesce(string_agg(text, chr(10) order by turn) filter (t <> ''), ''), '\s+', ' ', 'g')) as t from c group by 1, 2),
k as (select *, row_number() over (partition by conv_id order by first) as k from g), h as (select *, substr(t, 1, 260) as h from k where t <> ''),
a as (select *, case when contains(h, '.') then length(h) - instr(reverse(h), '.') + 1 else 0 end as a from h)
select conv_id as document_id, 'p' || p as parent_id, conv_id || '-summary-' || lpad(k::varchar, 4, '0') as chunk_id, '父段摘要：' || case when length(t) <= 260 then t when a > 40 then substr(h, 1, a) else rtrim(h) || '...' end as text, n as n_children from a""")
def fm5(spark, d):
    c = table(spark, d, "conversations").filter("text is not null")
    kind = F.when(F.col("turn") % 7 == 6, "summary")
    return index.parent_summaries(c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), F.concat(F.lit("p"), F.floor(F.col("turn") / 3).cast("string")).alias("parent_id"), kind.alias("kind"), "text"))


@query("st8_versioned_promote", """
with s as (select o_custkey as document_id, o_orderkey % 6 as version, o_orderkey % 4 as job, o_orderkey % 10 > 0 as whole from orders),
l as (select document_id, arg_max(struct_pack(v := version, j := job, w := whole), version * 10 + job) as s from (select document_id, version, job, bool_and(whole) as whole from s group by all) group by 1),
j as (select document_id, s, case when document_id % 3 > 0 then document_id % 7 end as v, document_id % 4 as j from l)
select document_id, case when v is not null and s.v < v then 'reject_lower' when s.v = v and s.j = j then 'no_change' when not s.w then 'reject_incomplete' else 'replace' end as action,
  case when not (v is not null and s.v < v) and not coalesce(s.v = v and s.j = j, false) and s.w then s.v else coalesce(v, -1) end as version from j""")
def st8(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 6).alias("version"), (F.col("o_orderkey") % 4).alias("job_id"), (F.col("o_orderkey") % 10 > 0).alias("whole"))
    staged = o.groupBy("document_id", "version", "job_id").agg(F.lit(5).alias("expected"), F.when(F.bool_and("whole"), 5).otherwise(4).alias("found"))
    k = F.col("c_custkey")
    current = table(spark, d, "customer").filter(k % 3 > 0).select(k.alias("document_id"), (k % 7).alias("version"), (k % 4).alias("job_id"))
    return index.promote(current, staged).withColumn("version", F.coalesce("version", F.lit(-1)))


@query("src18_index_write", "select conv_id as document_id, count(*) as n, sum(length(case when conv_id % 3 = 0 then text || '!' else text end))::bigint as size from conversations where text is not null group by 1")
def src18(spark, d):
    """Writes the index, writes a third of the documents again, and reads it back."""
    c = table(spark, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("document_id"), "turn", "text")
    path = new_folder(spark, "index")
    index.write(c, path)
    index.write(c.filter("document_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))), path)
    return spark.read.parquet(path).groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))


@query("src20_corpus_scan", """
select l_orderkey, l_linenumber, row_number() over (order by o_orderdate desc, l_orderkey, l_linenumber) as place from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'O' and l_returnflag = 'N' and o_custkey % 50 = 1
order by o_orderdate desc, l_orderkey, l_linenumber limit 200""")
def src20(spark, d):
    """The newest chunks of some owners' documents."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").filter("o_orderstatus = 'O' and o_custkey % 50 = 1").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    order = [F.desc("o_orderdate"), "l_orderkey", "l_linenumber"]
    first = table(spark, d, "lineitem").filter("l_returnflag = 'N'").join(o, "l_orderkey").orderBy(*order).limit(200)
    return first.select("l_orderkey", "l_linenumber", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("src17_eval_io", "select item_id, text, length(text)::bigint as n from benchmark")
def src17(spark, d):
    """Cases as JSON lines and as CSV, written and read again."""
    b, path = table(spark, d, "benchmark"), new_folder(spark, "eval")
    b.write.json(f"{path}/cases")
    b.select("item_id", F.length("text").cast("long").alias("n")).write.option("header", True).csv(f"{path}/sizes")
    cases = spark.read.schema("item_id long, text string").json(f"{path}/cases")
    return cases.join(spark.read.schema("item_id long, n long").option("header", True).csv(f"{path}/sizes"), "item_id").select("item_id", "text", "n")


@query("src14_parts", """
with p as (select conv_id, turn, text, count(*) over w as n, sum(octet_length(text::blob)) over w as size from conversations where text is not null window w as (partition by conv_id)),
g as (select conv_id, string_agg(text, '' order by turn) as whole, any_value(n) as n, max(turn) + 1 as expected from p group by 1)
select conv_id, n = expected as complete, case when n = expected then sha256(whole) end as digest from g""")
def src14(spark, d):
    """Parts of an upload in order of their number, if all are there."""
    c = table(spark, d, "conversations").filter("text is not null")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"), (F.max("turn") + 1).alias("expected"))
    complete = F.size("p") == F.col("expected")
    return g.select("conv_id", complete.alias("complete"), F.when(complete, F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), ""), 256)).alias("digest"))
