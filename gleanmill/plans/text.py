"""Queries of the text functions and of text filters, over documents, conversations, events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table
from .registry import query

_HEAD = "select doc_id, substr(text, 1, 400) as t from documents"


def _heads(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("sf1_tokens", r"""
with t as (select doc_id, list_transform(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_+#.-]+'), lambda x: lower(x)) as t from documents)
select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct, t[1] as first_token, t[len(t)] as last_token from t""")
def sf1(spark, sf_dir):
    t = _heads(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"), F.get("t", F.size("t") - 1).alias("last_token"))


@query("sf2_normalize", r"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as h from documents""")
def sf2(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", F.md5(T.normalized(F.col("text"))).alias("h"))


@query("sf3_collapse", r"select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as h from documents")
def sf3(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", F.md5(T.collapsed(F.col("text"))).alias("h"))


@query("sf4_dedupe_key", r"select doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}]+', '', 'g'))) as h from documents")
def sf4(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", F.md5(T.dedupe_key(F.col("text"))).alias("h"))


@query("sf5_compact", r"""
with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
select doc_id, case when length(t) > 220 then rtrim(substr(t, 1, 220)) || '...' else t end as snippet from t""")
def sf5(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", T.compact(F.col("text"), 220).alias("snippet"))


@query("sf6_extract_summary", r"""
with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents),
h as (select *, substr(t, 1, 180) as h from t),
a as (select *, case when contains(h, '.') then length(h) - instr(reverse(h), '.') + 1 else 0 end as a from h)
select doc_id, case when length(t) <= 180 then t when a > 40 then substr(h, 1, a) else rtrim(h) || '...' end as summary from a""")
def sf6(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", T.extract_summary(F.col("text"), 180).alias("summary"))


@query("sf7_headings", r"""
with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as l from documents)
select doc_id, count(*) filter (regexp_matches(l, '^#{1,6} \S') or (length(l) <= 32 and regexp_matches(l, '[:\x{ff1a}]$')))::bigint as n_headings, count(*)::bigint as n_lines from l group by 1""")
def sf7(spark, sf_dir):
    lines = _heads(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_heading(F.col("l"))).alias("n_headings"), F.count("*").alias("n_lines"))


@query("sf8_clock_seconds", """
select event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) as clock, s::int as seconds, (s // 120 * 120)::bigint as bucket
from (select event_id, (event_id * 37 % 86400)::bigint as s from events)""")
def sf8(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", T.clock(F.col("event_id") * 37 % 86400).alias("clock"))
    e = e.withColumn("seconds", T.seconds(F.col("clock")))
    return e.withColumn("bucket", T.time_bucket(F.col("seconds"), 120))


@query("sf10_local_day", """
select event_id, date_trunc('day', ts at time zone 'UTC' at time zone 'Asia/Shanghai') at time zone 'Asia/Shanghai' at time zone 'UTC' as day_start,
  ts >= date_trunc('day', ts at time zone 'UTC' at time zone 'Asia/Shanghai') at time zone 'Asia/Shanghai' at time zone 'UTC' as inside from events""")
def sf10(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai")
    start = F.to_utc_timestamp(F.date_trunc("day", local), "Asia/Shanghai").cast("timestamp_ntz")
    return e.select("event_id", start.alias("day_start"), (F.col("ts") >= start).alias("inside"))


@query("sf12_recency", """
select event_id, round(exp(-greatest(date_diff('day', ts::date, date '2024-02-01'), 0) / 30.0), 6)::double as recency from events""")
def sf12(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    days = F.date_diff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date"))
    return e.select("event_id", F.round(T.recency(days), 6).alias("recency"))


@query("sf13_scope_priority", """
select c_custkey, case upper(c_mktsegment) when 'BUILDING' then 1.0 when 'MACHINERY' then 0.8 when 'HOUSEHOLD' then 0.55 else 0.4 end::double as priority from customer""")
def sf13(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = F.upper("c_mktsegment")
    scope = F.when(s == "BUILDING", "TASK").when(s == "MACHINERY", "MATERIAL").when(s == "HOUSEHOLD", "USER").otherwise("OTHER")
    return c.select("c_custkey", T.scope_priority(scope).alias("priority"))


@query("sf16_stable_ids", "select doc_id, substr(sha1(lang || '|' || source || '|' || doc_id), 1, 10) as slug, sha256(text) as content_hash from documents")
def sf16(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.stable_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("slug"), F.sha2("text", 256).alias("content_hash"))


@query("sf17_mask_variables", r"""
select page_id, md5(regexp_replace(regexp_replace(html, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '{uuid}', 'g'), '\d{4,}', '{num}', 'g')) as h from pages""")
def sf17(spark, sf_dir):
    """The digest of the whole masked page."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.masked_variables(F.col("html"))).alias("h"))


@query("sf18_top_frame", r"""
with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) as l from documents)
select doc_id, coalesce(list_filter(l, lambda x: contains(x, 'License'))[1], list_filter(l, lambda x: starts_with(x, 'at '))[1], l[1]) as frame from l""")
def sf18(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", T.top_frame(F.col("text"), "License").alias("frame"))


@query("sf20_json_extract", """
select event_id, json_extract_string(props, '$.k') as k, coalesce(try_cast(json_extract_string(props, '$.k') as int), -1)::int as k_int from events""")
def sf20(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k.try_cast("int"), F.lit(-1)).alias("k_int"))


@query("sf21_ngram_jaccard", r"""
with t as (select conv_id, turn, lower(regexp_replace(text, '\s+', '', 'g')) as t from conversations),
g as (select conv_id, turn, list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substr(t, i, 3))) as g from t where length(t) > 0),
p as (select a.conv_id, a.turn, a.g as a, b.g as b from g a join g b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, round(len(list_intersect(a, b)) / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1)::double, 6) as jaccard from p""")
def sf21(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.char_ngrams(F.col("text"), 3).alias("g")).filter(F.size("g") > 0)
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("b"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("g"), F.col("b")), 6).alias("jaccard"))


@query("sf29_keyword_coverage", r"""
with q as (select item_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_+#.-]+'), lambda x: lower(x)))) as term from benchmark),
d as (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_+#.-]+'), lambda x: lower(x)))) as term from documents),
n as (select item_id, count(*) as n from q group by 1)
select item_id, doc_id, round(count(*) / n::double, 6) as coverage from q join d using (term) join n using (item_id) group by item_id, doc_id, n""")
def sf29(spark, sf_dir):
    """All pairs that share a term."""
    from ..operators.retrieval import shared_terms

    return shared_terms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "doc_id", F.round("coverage", 6).alias("coverage"))


@query("sf42_token_estimate", "select conv_id, turn, ((length(text) + 1) // 2)::bigint as n from conversations")
def sf42(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("n"))


@query("sf45_zh_ratio", r"""
with c as (select doc_id, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) as z, len(regexp_extract_all(text, '[A-Za-z]')) as l from documents)
select doc_id, case when z + l > 0 then z / (z + l)::double else 0.0 end as ratio from c""")
def sf45(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", T.zh_ratio(F.col("text")).alias("ratio"))


@query("sf48_backoff", "select event_id, least(3600, pow(2, least(event_id % 12, 8))::int)::int as wait from events")
def sf48(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.backoff(F.col("event_id") % 12).alias("wait"))


@query("flt3_section_keyword", "select doc_id from documents where contains(lower(lang || ' ' || source), 'src1') or contains(lower(lang || ' ' || source), 'de ')")
def flt3(spark, sf_dir):
    section = F.lower(F.concat_ws(" ", "lang", "source"))
    return table(spark, sf_dir, "documents").filter(section.contains("src1") | section.contains("de ")).select("doc_id")


@query("flt2_exact_in", "select doc_id, lang from documents where coalesce(source::varchar, '') in ('src1', 'src2') and coalesce(lang, '') = 'en'")
def flt2(spark, sf_dir):
    from ..operators.filters import matches

    d = table(spark, sf_dir, "documents")
    return d.filter(matches({"source": ["src1", "src2"], "lang": "en", "color": "red", "parser": ""}, {"source", "lang"})).select("doc_id", "lang")


@query("flt7_keyword_search", """
select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) as rank from part where p_name ilike '%a%' or p_brand ilike '%12%' or p_type ilike '%steel%'
order by p_retailprice desc, p_partkey limit 20""")
def flt7(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%a%") | F.col("p_brand").ilike("%12%") | F.col("p_type").ilike("%steel%"))
    order = [F.desc("p_retailprice"), "p_partkey"]
    return p.orderBy(*order).limit(20).select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


@query("flt9_nul_varchar", "select doc_id, substr(replace(text, chr(0), ''), 1, 64) as guarded from documents")
def flt9(spark, sf_dir):
    return _heads(spark, sf_dir).select("doc_id", F.substring(T.strip_nul(F.col("text")), 1, 64).alias("guarded"))


@query("flt13_playback_url", r"""
select page_id, case when url like '%example.com%' then regexp_replace(url, '#.*$', '') || '#t=' || (page_id * 7 % 600) else '/videos?page=' || page_id || '&t=' || (page_id * 7 % 600) end as link from pages""")
def flt13(spark, sf_dir):
    sec = (F.col("page_id") * 7 % 600).cast("string")
    link = F.when(F.col("url").contains("example.com"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#t="), sec))
    return table(spark, sf_dir, "pages").select("page_id", link.otherwise(F.concat(F.lit("/videos?page="), F.col("page_id").cast("string"), F.lit("&t="), sec)).alias("link"))


@query("flt14_date_range", "select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-04-01' order by o_orderdate desc, o_orderkey")
def flt14(spark, sf_dir):
    d = F.col("o_orderdate")
    o = table(spark, sf_dir, "orders").filter((d >= F.lit("1995-01-01").cast("timestamp_ntz")) & (d < F.lit("1995-04-01").cast("timestamp_ntz")))
    return o.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("src15_url_extract", r"""
select page_id, regexp_extract(url, '^(https?)://', 1) as scheme, lower(regexp_extract(url, '://([^/?#]+)', 1)) as host, regexp_extract(url, '[?&]page=([^&#]*)', 1) as page,
  regexp_matches(url, '^https?://([a-z-]+\.)*example\.(com|org)/') as allowed from pages""")
def src15(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "^(https?)://", 1).alias("scheme"), F.lower(F.regexp_extract(u, "://([^/?#]+)", 1)).alias("host"), F.regexp_extract(u, "[?&]page=([^&#]*)", 1).alias("page"), u.rlike(r"^https?://([a-z-]+\.)*example\.(com|org)/").alias("allowed"))


@query("agg9_term_frequency", r"""
with t as (select doc_id, lower(unnest(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_+#.-]+'))) as term from documents),
c as (select doc_id, term, count(*)::bigint as tf from t group by all)
select term, count(*)::bigint as df, sum(tf)::bigint as tf, max(tf)::bigint as most from c group by 1""")
def agg9(spark, sf_dir):
    from ..operators.retrieval import postings

    p = postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("most"))
