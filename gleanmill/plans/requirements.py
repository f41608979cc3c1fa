"""Queries of requirement analysis and of what a material is: documents stand for job texts and materials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as C
from ..operators import requirements as Q
from ..session import table
from .registry import query


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _has(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query("sf36_skills", rf"""
with t as (select item_id, text from benchmark), f as (select item_id, list_concat(list_filter({_list(Q.SKILLS)}, lambda s: contains(lower(text), lower(s))),
  list_filter(regexp_extract_all(text, '{Q.SKILL_TOKEN}'), lambda x: not list_contains({_list(Q.NO_SKILLS)}, lower(x)))) as f from t),
u as (select item_id, list_filter(f, lambda x, i: list_position(f, x) = i)[:12] as f from f)
select item_id, case when len(f) > 0 then array_to_string(f, '|') else '{Q.ANY_SKILL}' end as skills from u""")
def sf36(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(Q.skills(F.col("text")), "|").alias("skills"))


_REQUIREMENTS = rf"""r as (select item_id, list_filter(list_transform(regexp_split_to_array(text, '[，。；;\n]|\. '), lambda x: regexp_replace(x, '^[ ，。；;、]+|[ ，。；;、]+$', '', 'g')), lambda x: length(x) between 2 and 40)[:6] as r from benchmark),
k as (select item_id, case when len(r) > 0 then r else {_list(Q.GENERIC_REQUIREMENTS)} end as r from r)"""


def _jobs(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("job_id"), F.regexp_replace("text", r"\. ", "。").alias("text"))


@query("sf37_requirement_alignment", rf"""with {_REQUIREMENTS}, e as (select item_id, unnest(range(len(r))) as i, r from k)
select item_id as job_id, i::int as place, r[i + 1] as requirement, case when item_id % 3 = 0 then 'missing' when i = 0 or contains(lower(substr(text, 1, 60)), lower(r[i + 1])) then 'supported' else 'weak' end as status from e join benchmark using (item_id)""")
def sf37(spark, d):
    each = _jobs(spark, d).select("job_id", "text", F.posexplode(Q.split_requirements(F.col("text"))).alias("place", "requirement"))
    resume = table(spark, d, "benchmark").select(F.col("item_id").alias("job_id"), F.substring("text", 1, 60).alias("resume"))
    status = Q.alignment(F.col("place"), F.col("requirement"), F.col("resume"), F.col("job_id") % 3)
    return each.join(resume, "job_id").select("job_id", "place", "requirement", status.alias("status"))


@query("sf56_requirement_profile", rf"""with {_REQUIREMENTS}, e as (select item_id, unnest(range(len(r))) as i, r from k),
w as (select item_id, i, r[i + 1] as q, list_filter(regexp_split_to_array(r[i + 1], '[\s、，,；;：:（）()和]+'), lambda x: length(x) >= 2 and not list_contains({_list(Q.VAGUE)}, x)) as w from e)
select item_id as job_id, 'req-' || i + 1 as id, case when i < 3 then 'HIGH' else 'MEDIUM' end as priority, case when len(w) > 0 then array_to_string(w[:6], '|') else substr(q, 1, 32) end as keywords from w""")
def sf56(spark, d):
    return Q.profile(_jobs(spark, d)).select("job_id", "id", "priority", F.array_join("keywords", "|").alias("keywords"))


@query("sf27_learning_content", rf"""
with c as (select doc_id, case when doc_id % 4 = 0 then '教程 ' when doc_id % 4 = 1 then '发票 ' when doc_id % 4 = 2 then '面试题 账单 ' else '' end as title, case when doc_id % 3 = 0 then '分布式 ' else '' end || lower(coalesce(text, '')) || case when doc_id % 5 = 0 then ' 用于 通过 为什么 如何' else '' end as t from documents),
f as (select *, title || t as corpus from c), g as (select *, least(len(regexp_extract_all(corpus, '{Q.QUESTIONS}')), 2) + least(len(regexp_extract_all(corpus, '{Q.STATEMENTS}')), 2) as form from f),
h as (select *, ({_has("corpus", Q.INTENT)} or ({_has("corpus", Q.TOPIC)} and form >= 2) or form >= 4) and not ({_has("title", Q.OTHER)} and not {_has("title", Q.INTENT)}) as good from g)
select doc_id, good as is_learning, case when not good then '非学习资料' {" ".join(f"when {_has('corpus', w)} then '{n}'" for n, w in Q.CLASSES)} else '学习资料' end as category from h""")
def sf27(spark, d):
    k = F.col("doc_id")
    title = F.when(k % 4 == 0, "教程 ").when(k % 4 == 1, "发票 ").when(k % 4 == 2, "面试题 账单 ").otherwise("")
    corpus = F.concat(title, F.when(k % 3 == 0, "分布式 ").otherwise(""), F.coalesce("text", F.lit("")), F.when(k % 5 == 0, " 用于 通过 为什么 如何").otherwise(""))
    return table(spark, d, "documents").select("doc_id", Q.learning_content(title, corpus).alias("c")).select("doc_id", "c.*")


@query("sf55_token_budget", """
with recursive s as (select conv_id, turn, text, length(text) as n, case when (length(text) + 1) // 2 <= 150 then length(text) else greatest(200, floor(length(text) * greatest(0.05, least(0.95, 150::double / ((length(text) + 1) // 2))) * 0.92)::bigint) end as k from conversations where text is not null
  union all select conv_id, turn, text, n, greatest(1, floor(k * 0.9)::bigint) from s where n > k and (k + 1) // 2 > 150),
m as (select conv_id, turn, any_value(text) as text, any_value(n) as n, min(k) as k from s group by 1, 2)
select conv_id, turn, case when k >= n then length(text) else length(rtrim(substr(text, 1, k))) end::int as size from m""")
def sf55(spark, d):
    return table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", F.length(Q.within_tokens(F.col("text"), 150)).alias("size"))


@query("sf58_time_offset", "select event_id, strftime(timestamp '2000-01-01' + to_seconds(event_id % 5000 + 90 * (user_id % 50)), '%H:%M:%S') as moved from events")
def sf58(spark, d):
    from ..functions.text import clock

    return table(spark, d, "events").select("event_id", Q.shifted(clock((F.col("event_id") % 5000).cast("int")), (F.col("user_id") % 50 * 90).cast("int")).alias("moved"))


@query("sf50_question_key")
def sf50(spark, d):
    """Spoken prefixes before each question; the keys are held against the questions' own in the tests."""
    c = table(spark, d, "conversations").filter("text is not null")
    spoken = F.concat(F.when(F.col("turn") % 2 == 0, "就是可能他会问你，嗯，").otherwise(""), "text")
    return c.select("conv_id", "turn", C.question_key(spoken).alias("key"))


@query("set6_card_dedupe", r"""
with k as (select conv_id, turn, coalesce(nullif(case when turn % 4 = 0 then '' else lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}\p{Nd}]+', '', 'g')) end, ''), 's' || turn % 3) as k from conversations)
select conv_id, turn from (select *, row_number() over (partition by k order by conv_id, turn) as n from k) where n = 1""")
def set6(spark, d):
    from ..operators.curation import first_card

    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, "").otherwise(F.coalesce("text", F.lit(""))).alias("question"), F.concat(F.lit("s"), F.col("turn") % 3).alias("source_key"))
    return first_card(c, ["conv_id", "turn"]).select("conv_id", "turn")
