"""Queries of evidence: what is shown of it, how good it is, whether it admits an answer, and what goes into a prompt."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import retrieval as R
from ..session import table
from .registry import query
from .retrieval import _BM25, _TOK, _bm25

_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_SNIP = "case when length({0}) > 220 then rtrim(substr({0}, 1, 220)) || '...' else {0} end"


_BARE = r"""regexp_replace(regexp_replace(trim(coalesce(text, '')), '^["''“”‘’]+|["''“”‘’]+$', '', 'g'), '^\s*(?:[-*]|\d+[.)、]|[（(]\d+[）)])\s*', '')"""


def _quality(x: str) -> str:
    """Of a text without runs of white space."""
    left, clocks = f"regexp_replace({x}, '{E.MARKS}', '', 'g')", f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '{E.CLOCK}'), lambda c: length(c))), 0)"
    contents = f"((contains({x}, '目录') and length({x}) < 80) or len(regexp_extract_all({x}, '{E.NUMBERED}')) >= 4 or (length({x}) - length(replace({x}, '...', ''))) / 3 >= 3)"
    return f"""case when {left} = '' or {left} in ('目录', '索引', '标题', '时间戳') then 0.0 else round_even(least(length({left}) / 80.0::double, 1.0) * case when length({left}) < 12 then 0.35 else 1.0 end
 * case when {clocks} / greatest(length({x}), 1) > 0.45 then 0.35 else 1.0 end * case when {contents} then 0.3 else 1.0 end, 6) end"""


@query("flt12_evidence", rf"""
with t as (select *, {_FLAT.format("text")} as t from documents)
select doc_id::varchar as evidence_id, doc_id as document_id, coalesce(nullif(source, ''), '未命名资料') as title, coalesce(nullif(lang, ''), '全文') as section, {_SNIP.format("t")} as snippet,
  coalesce(nullif(source, ''), 'unknown') as source, case when doc_id % 2 = 0 then 'https://h.example/' || doc_id end as source_path, round_even(n_chars / 7000.0::double, 6) as score from t""")
def flt12(spark, d):
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" https://h.example/"), "doc_id")).otherwise(F.concat(F.lit("/data/"), "doc_id"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text", F.col("source").alias("title"), F.col("lang").alias("section"), "source", path.alias("source_path"), (F.col("n_chars") / 7000.0).alias("score"))
    return E.project(chunks)


@query("flt8_public_metadata", """
select page_id, array_to_string(list_filter([case when page_id % 3 > 0 then 'page_url=' || url end, 'title=p' || page_id], lambda x: x is not null), ',') as shown from pages""")
def flt8(spark, d):
    own = F.when(F.col("page_id") % 3 > 0, F.col("url")).otherwise(F.concat(F.lit("oss://bucket/"), "page_id"))
    view = E.public_metadata(F.array(F.lit("page_url"), F.lit("asset_path"), F.lit("title")), F.array(own, F.concat(F.lit("/srv/"), "page_id"), F.concat(F.lit("p"), "page_id")))
    return table(spark, d, "pages").select("page_id", view.alias("m")).select("page_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("shown"))


@query("flt11_metadata_view", """
select event_id, case when event_type = 'view' then 'block' else event_type end as channel, 'b' || user_id as note, cast(null as varchar) as other from events""")
def flt11(spark, d):
    e = table(spark, d, "events")
    chunk = F.create_map(F.lit("channel"), F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("other"), F.lit("hidden"))
    block = F.create_map(F.lit("channel"), F.lit("block"), F.lit("note"), F.concat(F.lit("b"), "user_id"))
    view = e.select("event_id", E.metadata_view(chunk, block, ("channel",)).alias("m"))
    return view.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("channel", "note", "other")])


@query("sf28_snippet_quality", rf"""
with t as (select conv_id, turn, {_FLAT.format("coalesce(text, '')")} as t from conversations) select conv_id, turn, round({_quality("t")}, 6)::double as quality from t""")
def sf28(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", E.snippet_quality(F.col("text")).alias("quality"))


_RERANKED = rf"""{_BM25}, h as (select item_id as query_id, doc_id, score, rank from bm where rank <= 10),
n as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from h),
qt as (select item_id as query_id, list_distinct({_TOK}) as q from benchmark), dt as (select doc_id, list_distinct({_TOK}) as d, [lower(source)] as ti from documents),
rs as (select query_id, doc_id, rank as first, round_even(least(greatest(0.40 * case when hi > lo then (score - lo) / (hi - lo) else greatest(0, least(1, score)) end
  + 0.35 * len(list_intersect(q, d)) / greatest(len(q), 1) + 0.15 * len(list_intersect(q, ti)) / greatest(len(q), 1) + 0.10 / rank, 0), 1), 6)::double as score from n join qt using (query_id) join dt using (doc_id)),
rr as (select *, row_number() over (partition by query_id order by score desc, first) as rank from rs)"""


def _reranked(spark, d):
    h = _bm25(spark, d).withColumnRenamed("item_id", "query_id")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    h = h.join(asked, "query_id").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), "source", "lang"), "doc_id")
    return R.rerank(h, F.col("question"), F.col("body"), F.col("source"))


@query("top5_rerank_order", f"with {_RERANKED} select query_id, doc_id, score, rank::int as rank from rr")
def top5(spark, d):
    return _reranked(spark, d).select("query_id", "doc_id", F.col("rerank_score").alias("score"), F.col("rerank_rank").alias("rank"))


@query("sf32_answer_guard", rf"""with {_RERANKED},
sn as (select query_id, rr.doc_id, rank, score, source as title, lang as section, {_SNIP.format("t")} as snippet, source = 'src7' as summary_only, rr.doc_id % 2 = 0 as located
  from rr join (select *, {_FLAT.format("text")} as t from documents) dd using (doc_id) where rank <= 5),
ev as (select *, {_quality("snippet")} as quality, list_transform(regexp_extract_all(concat_ws(' ', title, section, snippet), '[\x{{4e00}}-\x{{9fff}}]|[a-zA-Z0-9_+#.-]+'), lambda x: lower(x)) as words from sn),
gg as (select query_id, arg_min(score, rank) as top, min(score) as low, max(score) as high, count(*) as n, arg_min(quality, rank) as quality, arg_min(located, rank) as located, bool_and(summary_only) as summaries,
  count(*) filter (quality >= 0.35 and not summary_only) as supporting, list_distinct(flatten(list(words))) as words from ev group by 1),
qq as (select item_id as query_id, item_id % 13 as k, list_distinct({_TOK}) as asked from benchmark),
jj as (select *, coalesce(len(list_intersect(asked, words)) / nullif(len(asked), 0), 0) as coverage, (case when k = 0 then 0 else 1 end) as candidates, (case when k = 1 then 0 else 1 end) as filtered, (case when k = 2 then 4 else 0 end) as removed from qq left join gg using (query_id)),
cc as (select *, least(greatest(round_even(case when high > low then (top - low) / (high - low) else 1.0 end, 6) * 0.4 + coverage * 0.25 + least(supporting, 1) * 0.2 + quality * 0.15
  - (0.08 + case when summaries then 0.25 else 0 end + case when removed / greatest(n, 1) >= 0.5 then 0.05 else 0 end), 0), 1) as score,
  case when located then top >= 0.25 * 0.84 and coverage >= 0.12 and quality >= 0.5 else top >= 0.25 * 0.8 and coverage >= 0.18 and quality >= 0.7 end as near from jj),
rz as (select *, case when candidates <= 0 then 'NO_EVIDENCE' when filtered <= 0 then 'FILTERED_OUT' when n is null then 'LOW_CONFIDENCE' when summaries then 'ONLY_DIAGNOSTIC_CANDIDATES' when quality < 0.35 then 'WEAK_SNIPPET' when top < 0.25 and not near then 'LOW_CONFIDENCE'
  when coverage < 0.08 then 'INSUFFICIENT_COVERAGE' when supporting < 1 then 'INSUFFICIENT_COVERAGE' when score < 0.45 then 'LOW_CONFIDENCE' end as reason, n is not null and candidates > 0 and filtered > 0 as judged from cc)
select query_id, case when reason is null then 'ANSWERED' else 'REFUSED' end as status, reason, case when judged then round(score, 4)::double else 0 end as confidence, case when judged then supporting else 0 end::bigint as supporting from rz""")
def sf32(spark, d):
    k = F.col("item_id") % 13
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.array().cast("array<string>").alias("variants"), F.when(k == 0, 0).otherwise(1).alias("candidates"), F.when(k == 1, 0).otherwise(1).alias("filtered"), F.when(k == 2, 4).otherwise(0).alias("removed"))
    e = _reranked(spark, d).filter("rerank_rank <= 5").select("query_id", F.col("rerank_rank").alias("rank"), F.col("rerank_score").alias("score"), F.col("source").alias("title"), F.col("lang").alias("section"), T.compact(F.col("body"), 220).alias("snippet"), (F.col("source") == "src7").alias("summary_only"), (F.col("doc_id") % 2 == 0).alias("located"))
    return E.admission(q, e).withColumn("confidence", F.round("confidence", 4))


def _variants_sql() -> str:
    when = " ".join("when " + " or ".join(f"contains(l, '{w}')" for w in words) + " then [" + ", ".join(f"'{a}'" for a in adds) + "]" for words, adds in E.INTENTS)
    return f"case {when} else [" + ", ".join(f"'{a}'" for a in E.ANY_INTENT) + "] end"


@query("sf33_query_variants", rf"""
with b as (select conv_id, turn, {_FLAT.format(_BARE)} as b from conversations where role = 'user'),
v as (select conv_id, turn, b, list_prepend(b, list_transform({_variants_sql()}, lambda a: b || ' ' || a)) as v from (select *, lower(b) as l from b) where b <> ''),
k as (select conv_id, turn, v, unnest(range(1, 5)) as k from v)
select conv_id, turn, k::int as k, substr(v[k], 1, 120) as variant from k""")
def sf33(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.posexplode(E.variants(F.col("text"))).alias("k", "variant")).withColumn("k", F.col("k") + 1)


@query("set5_evidence_dedupe", rf"""
with t as (select conv_id, turn, role, {_FLAT.format("coalesce(text, '')")} as t from conversations), c as (select *, case when length(t) > 600 then rtrim(substr(t, 1, 600)) || '...' else t end as c from t where t <> ''),
n as (select *, row_number() over (partition by trim(role), lower(regexp_replace(c, '[^\p{{L}}\p{{M}}\p{{Nd}}]+', '', 'g')) order by conv_id, turn) as n from c)
select conv_id, turn, role, md5(c) as h from n where n = 1""")
def set5(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return E.first_of_text(c, "role", "text", ["conv_id", "turn"]).select("conv_id", "turn", "role", F.md5("text").alias("h"))


@query("win13_adjacent_subtitles", """
with e as (select event_id, user_id, ts, event_type, case when event_type = 'error' then 'text' else 'subtitle' end as channel from events),
l as (select *, lag(channel) over w as before, lag(event_type) over w as value from e window w as (partition by user_id order by ts, event_id))
select event_id, user_id from l where not (channel = 'subtitle' and coalesce(before, '') = 'subtitle' and value = event_type)""")
def win13(spark, d):
    e = table(spark, d, "events").withColumn("channel", F.when(F.col("event_type") == "error", "text").otherwise("subtitle"))
    return E.without_adjacent_repeats(e, "user_id", ["ts", "event_id"], "channel", "event_type").select("event_id", "user_id")


_KIND = "case event_type when 'error' then 'visual' when 'signup' then 'summary' else 'primary' end"


@query("top11_representatives", f"""
with e as (select user_id, event_id, {_KIND} as kind, row_number() over (partition by user_id, {_KIND} order by ts, event_id) - 1 as i, count(*) over (partition by user_id, {_KIND}) as n from events),
c as (select user_id, least(count(*) filter (kind = 'primary'), 12) as p, count(*) filter (kind = 'visual') as v from e group by 1), s as (select user_id, p, least(v, 4, 20 - p) as v, 20 - p - least(v, 4, 20 - p) as s from c),
k as (select e.*, case kind when 'primary' then p when 'visual' then v else s end as k from e join s using (user_id))
select user_id, event_id, kind from k where k > 0 and (n <= k or (k = 1 and i = n // 2) or (k > 1 and list_contains(list_transform(range(k), lambda j: round_even(j * (n - 1) / (k - 1)::double, 0)), i)))""")
def top11(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") == "error", "visual").when(F.col("event_type") == "signup", "summary").otherwise("primary"))
    return E.representatives(e, "user_id", "kind", ["ts", "event_id"], 20).select("user_id", "event_id", "kind")


@query("top13_preferred_with_followers", """
with l as (select *, value > 150 as p, lag(value > 150) over (partition by user_id order by ts, event_id) as f from events) select event_id, user_id from l where coalesce(p, false) or coalesce(f, false)""")
def top13(spark, d):
    return E.with_followers(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") > 150).select("event_id", "user_id")


@query("top3_candidate_budget", "select item_id, greatest((1 + item_id % 20) * (2 + item_id % 9), 20)::bigint as budget from benchmark")
def top3(spark, d):
    k, m = 1 + F.col("item_id") % 20, 2 + F.col("item_id") % 9
    return table(spark, d, "benchmark").select("item_id", F.greatest(k * m, F.lit(20)).cast("long").alias("budget"))


@query("jn14_dimension_lookup", "select event_id, user_id, c_name, c_mktsegment from events left join customer on c_custkey = user_id")
def jn14(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return table(spark, d, "events").select("event_id", "user_id").join(c, "user_id", "left").select("event_id", "user_id", "c_name", "c_mktsegment")


@query("win3_rank_in_run", f"""with {_BM25} select item_id as query_id, 0::bigint as variant, 'bm25' as source, doc_id, rank::bigint as rank from bm where rank <= 5""")
def win3(spark, d):
    h = R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), k=5)
    ranked = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return h.select(F.col("item_id").alias("query_id"), F.lit(0).cast("long").alias("variant"), F.lit("bm25").alias("source"), "doc_id", ranked.cast("long").alias("rank"))
