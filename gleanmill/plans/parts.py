"""Queries of operators that are parts of larger ones: each by itself, over its whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import requirements as Q
from ..operators import retrieval as R
from ..operators import review
from ..operators import scoring as S
from ..session import table
from .registry import query
from .retrieval import _BM25, _RUNS, _TOK, _bm25, _runs


@query("flt10_varchar_guard", "select conv_id, turn, substr(text, 1, 40) as guarded, length(text) > 40 as shortened from conversations")
def flt10(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 40).alias("guarded"), (F.length("text") > 40).alias("shortened"))


@query("sf9_time_bucket", "select event_id, (epoch(date_trunc('second', ts))::bigint % 86400) // 60 * 60 as minute, (epoch(date_trunc('second', ts))::bigint % 86400) // 120 * 120 as pair from events")
def sf9(spark, d):
    s = F.unix_timestamp(F.col("ts").cast("timestamp")) % 86400
    return table(spark, d, "events").select("event_id", T.time_bucket(s, 60).alias("minute"), T.time_bucket(s, 120).alias("pair"))


@query("sf22_bigram_similarity", r"""
with t as (select conv_id, turn, lower(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}]+', '', 'g')) as t from conversations where text is not null),
g as (select conv_id, turn, list_distinct(list_transform(range(1, greatest(length(t) - 1, 1) + 1), lambda i: substr(t, i, 2))) as g from t where t <> '')
select a.conv_id, a.turn, round(len(list_intersect(a.g, b.g)) / greatest(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 1)::double, 6) as similarity from g a join g b on a.conv_id = b.conv_id and b.turn = a.turn + 1""")
def sf22(spark, d):
    c = table(spark, d, "conversations").filter("text is not null").withColumn("k", T.dedupe_key(F.col("text"))).filter("k <> ''").select("conv_id", "turn", T.char_ngrams(F.col("k"), 2).alias("g"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("b"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("g"), F.col("b")), 6).alias("similarity"))


@query("jn8_inverted_index", f"""
with p as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOK}) as term from documents) group by all), q as (select distinct item_id, unnest({_TOK}) as term from benchmark)
select item_id, doc_id, count(*) as n_terms, sum(tf)::bigint as tf from p join q using (term) group by 1, 2""")
def jn8(spark, d):
    return R.term_matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("top1_bm25_order", f"""with {_BM25}, sn as (select doc_id, row_number() over (order by n_chars desc, doc_id) as scan from documents),
rz as (select item_id, doc_id, row_number() over (partition by item_id order by round(score, 6) desc, scan) as place from bm join sn using (doc_id) where rank <= 20) select item_id, doc_id, place from rz where place <= 5""")
def top1(spark, d):
    """Equal scores keep the order of the scan."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 6)), F.desc("n_chars"), "doc_id")).cast("long")
    return _bm25(spark, d, 20).join(docs, "doc_id").select("item_id", "doc_id", place.alias("place")).filter("place <= 5")


@query("top4_fusion_order", f"with {_RUNS} select query_id, doc_id, place from (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, best_rank, doc_id) as place from fused) where place <= 3")
def top4(spark, d):
    return R.fuse(_runs(spark, d), "doc_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("place")).filter("place <= 3")


@query("sf31_rrf_contribution", f"""with {_RUNS}
select query_id, variant::bigint as variant, source, doc_id, round(weight * case when variant = 0 then 1.2 else 1.0 end / (60 + rank) * (1 + 0.15 * case when hi > lo then (score - lo) / (hi - lo) when score > 0 then 1.0 else 0.0 end), 8)::double as contribution from nm""")
def sf31(spark, d):
    x = R.contributions(_runs(spark, d))
    return x.select("query_id", F.col("variant").cast("long").alias("variant"), "source", "doc_id", F.round("contribution", 8).alias("contribution"))


@query("fm10_segment_merge", """
select conv_id as document_id, turn // 4 as segment, strftime(timestamp '2000-01-01' + to_seconds(turn // 4 * 600 + turn % 4 * 35), '%H:%M:%S') as start, row_number() over (partition by conv_id order by turn // 4 * 600 + turn % 4 * 35, turn) as place from conversations""")
def fm10(spark, d):
    """Segments with times of their own, put behind each other."""
    segment, own = F.floor(F.col("turn") / 4), (F.col("turn") % 4 * 35).cast("int")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), segment.alias("segment"), "turn", Q.shifted(T.clock(own), (segment * 600).cast("int")).alias("start"))
    return c.select("document_id", "segment", "start", F.row_number().over(Window.partitionBy("document_id").orderBy("start", "turn")).cast("long").alias("place"))


@query("agg30_merged_quality", r"""
with b as (select conv_id, count(*) as n, sum(length(text)) as c, count(*) filter (turn % 3 = 0) as m, count(*) filter (text is null or text = '') as em from conversations group by 1)
select conv_id, round(greatest(0, least(1, 1 - ((case when c < 80 then 0.35 else 0.0 end)::double + (case when c >= 80 and c < 300 then 0.15 else 0.0 end)::double + (case when n = 0 then 0.25 else 0.0 end)::double
  + (case when c < 120 and m >= 1 then 0.3 else 0.0 end)::double + (case when em / n::double >= 0.75 then 0.15 else 0.0 end)::double + (case when em > 0 then 0.08 else 0.0 end)::double))), 4) as score from b""")
def agg30(spark, d):
    """The parse quality of a document put together from its segments."""
    empty = F.count_if(F.col("text").isNull() | (F.col("text") == ""))
    b = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.count_if(F.col("turn") % 3 == 0).alias("m"), empty.alias("em"))
    q = S.parse_quality(F.col("c"), F.col("n"), F.lit(0), F.col("m"), F.col("em") / F.col("n"), F.col("em"))
    return b.select("conv_id", q.alias("q")).select("conv_id", "q.score")


@query("dml9_complete_reorder", """
with i as (select user_id as owner, event_id as item, row_number() over (partition by user_id order by value, event_id) - 1 as old from events),
q as (select owner, list(item order by item)[1:3] as ids from i group by 1), a as (select owner, unnest(ids) as item, unnest(range(len(ids))) as pos from q)
select owner, item, (row_number() over (partition by owner order by pos nulls last, old, item) - 1)::bigint as new from i left join a using (owner, item)""")
def dml9(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("item"), "value")
    items = e.select("owner", "item", (F.row_number().over(Window.partitionBy("owner").orderBy("value", "item")) - 1).cast("long").alias("position"))
    asked = e.groupBy("owner").agg(F.slice(F.sort_array(F.collect_list("item")), 1, 3).alias("ids"))
    return review.reorder(items, asked, "item", "position").select("owner", "item", "new")
