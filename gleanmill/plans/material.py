"""Queries of learning materials: cleaned contents, their questions and terms, progress, frames and near-duplicate candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import material as M
from ..operators import timeline
from ..session import table
from .registry import query


@query("sf52_cleaned", r"""
select conv_id, turn, regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '^[，。；：:,.!?！？、-]+\s*', '') as cleaned from conversations""")
def sf52(spark, d):
    """Texts as screens and subtitles give them; cleaned they are the text again."""
    marked = F.concat(F.lit("OCR 出现时间：00:01:02\n父段摘要："), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, "\n视频画面聚合 01:02 - 01:05").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", M.cleaned(marked).alias("cleaned"))


def _evidence(spark, d):
    said = F.concat(F.when(F.col("turn") % 2 == 0, "为什么 quorum 要过半，它有什么作用？").otherwise("本节介绍如何选举。"), F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("evidence_id"), F.col("turn").alias("position"), F.when(F.col("turn") % 5 == 4, "summary").alias("kind"), F.lit("").alias("channel"), F.when(F.col("turn") % 3 == 0, "raft 是什么？").otherwise("全文").alias("section"), said.alias("text"))


@query("set15_source_questions")
def set15(spark, d):
    """Look-behinds have no SQL; hand cases are in the tests."""
    return M.source_questions(_evidence(spark, d)).select("evidence_id", "k", "question")


@query("set16_structured_questions")
def set16(spark, d):
    """Every sentence of a conversation's whole turns asked about; hand cases are in the tests, as look-behinds have no SQL."""
    sentences = F.posexplode(F.split("text", r"[.!?\n]+")).alias("k", "s")
    c = table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", sentences)
    asked = F.concat(F.lit("为什么 node "), F.trim("s"), F.lit(" 需要选举？"))
    return M.structured_questions(c.select("conv_id", (F.col("turn") * 100_000 + F.col("k")).alias("place"), asked.alias("question")), "conv_id")


@query("sf43_weighting_terms", r"""
with t as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#.]{2,}')) as t from benchmark), u as (select item_id, unnest(t) as t from t),
r as (select item_id, t, row_number() over (partition by item_id order by length(t) desc, t) as n from u)
select item_id, n::int as place, t as term from r where n <= 80""")
def sf43(spark, d):
    terms = M.weighting_terms(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(terms).alias("place", "term")).withColumn("place", F.col("place") + 1)


@query("sf57_section_policy", """
with t as (select doc_id, case doc_id % 5 when 0 then '项目 系统' when 1 then '教育 学院' when 2 then '技术栈' when 3 then '论文' else '' end || ' ' || source as t from documents)
select doc_id, case doc_id % 5 when 0 then 'project_experience' when 1 then 'education' when 2 then 'skills' when 3 then 'research' else 'other' end as section, case when doc_id % 5 in (0, 2, 3) then 'REQUIRED' else 'OPTIONAL' end as policy from t""")
def sf57(spark, d):
    k = F.col("doc_id") % 5
    t = F.concat(F.when(k == 0, "项目 系统").when(k == 1, "教育 学院").when(k == 2, "技术栈").when(k == 3, "论文").otherwise(""), F.lit(" "), "source")
    return table(spark, d, "documents").select("doc_id", M.section_key(t).alias("section")).withColumn("policy", M.evidence_policy(F.col("section")))


@query("sf38_percent", """
select event_id, case when event_type in ('signup') then 100 when user_id % 3 = 0 then greatest(0, least(100, (value - 20)::int)) else greatest(0, least(99, round_even((event_id % 6 + case when user_id % 2 = 0 then 1.0 else 0.25 end) * 100 / 6, 0)))::int end as percent from
  (select event_id, user_id, event_type, floor(value) as value from events)""")
def sf38(spark, d):
    status = F.when(F.col("event_type") == "signup", "READY").otherwise("INDEXING")
    own = F.when(F.col("user_id") % 3 == 0, F.floor("value") - 20)
    return table(spark, d, "events").select("event_id", M.percent(status, own, F.col("event_id") % 6, F.col("user_id") % 2 == 0).cast("int").alias("percent"))


@query("src3_text_decode", "select doc_id, md5(text) as h from documents where text is not null")
def src3(spark, d):
    """Every third text with a byte order mark."""
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.encode("text", "UTF-8"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(M.decoded(raw)).alias("h"))


def _frames(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long").alias("second"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("g"), F.col("event_id") % 40)).alias("group_id"),
        F.when(F.col("event_type") == "signup", "initial_slide").when(F.col("event_type") == "error", "ambiguous_visual").otherwise("interval").alias("trigger"), (F.col("event_id") % 3).alias("priority"),
    )


@query("top15_frame_budget")
def top15(spark, d):
    """What was taken decides what may follow, which SQL cannot say; the tests hold the whole table against a plain loop."""
    return M.frame_budget(_frames(spark, d), 12, 600)


@query("fm16_visual_ranges", """
with f as (select user_id as video_id, event_id as frame, floor(epoch(ts))::bigint % 80000 as second, case when event_id % 4 > 0 then 'g' || event_id % 40 end as group_id, event_type = 'view' as seen from events),
t as (select video_id, group_id, list_sort(list(distinct strftime(timestamp '2000-01-01' + to_seconds(second), '%H:%M:%S'))) as times from f where not seen and group_id is not null group by 1, 2),
s as (select *, row_number() over (partition by video_id, group_id order by second, frame) as n from f where seen)
select video_id, frame, second, group_id, coalesce(case when n = 1 and group_id is not null then array_to_string(times, ',') end, '') as times from s left join t using (video_id, group_id)""")
def fm16(spark, d):
    f = _frames(spark, d).withColumn("second", F.col("second") % 80000).join(table(spark, d, "events").select(F.col("event_id").alias("frame"), (F.col("event_type") == "view").alias("seen")), "frame")
    f = f.withColumn("group_id", F.when(F.col("frame") % 4 > 0, F.col("group_id")))
    return M.visual_ranges(f.filter("seen").select("video_id", "frame", "second", "group_id"), f.filter("not seen").select("video_id", "second", "group_id")).withColumn("times", F.array_join("times", ","))


@query("jn11_near_candidates", r"""
with recursive c as (select conv_id as document_id, turn * 10 as start, turn * 10 + 5 as "end", text from conversations where text is not null),
a as (select * from c union all select document_id, start + 3, "end", substr(text, 2) from c where start % 20 = 0),
k as (select *, lower(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}]+', '', 'g')) as key from a),
o as (select *, row_number() over (partition by document_id order by start, "end", key) as rn, list_distinct(list_transform(range(1, length(key)), lambda i: substr(key, i, 2))) as p from k),
b as (select x.document_id, y.rn, list(x.rn) as before from o x join o y on x.document_id = y.document_id and x.rn < y.rn
 and ((least(length(x.key), length(y.key)) >= 10 and (contains(x.key, y.key) or contains(y.key, x.key))) or (len(x.p) > 0 and len(y.p) > 0 and len(list_intersect(x.p, y.p)) / len(list_distinct(list_concat(x.p, y.p))) >= 0.88)) group by 1, 2),
n as (select o.*, coalesce(before, []) as before from o left join b using (document_id, rn)),
f as (select document_id, rn, true as keep, [rn] as kept from n where rn = 1
 union all select n.document_id, n.rn, not list_has_any(f.kept, n.before), case when list_has_any(f.kept, n.before) then f.kept else list_append(f.kept, n.rn) end from f join n on n.document_id = f.document_id and n.rn = f.rn + 1)
select document_id, start, "end" from f join o using (document_id, rn) where keep""")
def jn11(spark, d):
    """Whole turns, and again those of every other turn without their first character, against those kept before."""
    c = table(spark, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("document_id"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 5).alias("end"), "text")
    again = c.filter("start % 20 = 0").withColumn("start", F.col("start") + 3).withColumn("text", F.expr("substring(text, 2)"))
    return M.without_near_candidates(c.unionByName(again))


@query("win10_window_parents", "select doc_id, doc_id // 50 as document_id, doc_id % 50 // 3 as parent, doc_id // 50 || '-window-' || (doc_id % 50) // 3 as parent_id from documents")
def win10(spark, d):
    k, p = F.floor(F.col("doc_id") / 50), F.floor(F.col("doc_id") % 50 / 3)
    return table(spark, d, "documents").select("doc_id", k.alias("document_id"), p.alias("parent"), F.concat(k.cast("string"), F.lit("-window-"), p.cast("string")).alias("parent_id"))


@query("fm8_correction_batches", """
with recursive c as (select conv_id as document_id, turn as item, length(text) as size, row_number() over (partition by conv_id order by turn) as rn from conversations where length(text) <= 1200),
f as (select document_id, item, size, rn, size as total, 1 as n, 0 as batch from c where rn = 1
 union all select c.document_id, c.item, c.size, c.rn, case when f.n >= 3 or f.total + c.size > 1200 then c.size else f.total + c.size end, case when f.n >= 3 or f.total + c.size > 1200 then 1 else f.n + 1 end,
  f.batch + case when f.n >= 3 or f.total + c.size > 1200 then 1 else 0 end from f join c on c.document_id = f.document_id and c.rn = f.rn + 1)
select document_id, item, batch::bigint as batch from f union all select conv_id, turn, -1 from conversations where length(text) > 1200""")
def fm8(spark, d):
    """Items that are larger than a batch go to a side output, here batch -1."""
    c = table(spark, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("item"), F.length("text").alias("size"))
    large = c.filter("size > 1200").select("document_id", "item", F.lit(-1).cast("long").alias("batch"))
    return timeline.packed(c.filter("size <= 1200"), 3, 1200).unionByName(large)
