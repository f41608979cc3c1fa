"""Queries of the retrieval chain: benchmark items are questions, documents the corpus, embeddings the vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..session import table
from .registry import query

_TOK = r"list_transform(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_+#.-]+'), lambda x: lower(x))"

_BM25 = rf"""
t as (select doc_id, {_TOK} as t from documents), l as (select doc_id, len(t) as length from t), s as (select count(*) as n, greatest(avg(length), 1.0) as mean from l),
p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from t) group by all),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_TOK}) as term from benchmark) group by all),
f as (select term, count(*) as df from p group by 1),
sc as (select item_id, p.doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) as score
  from q join p using (term) join f using (term) join l on l.doc_id = p.doc_id, s group by 1, 2),
bm as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from sc where score > 0)"""

_VEC = """
vs as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score from embeddings q, embeddings v where q.vec_id % 100 = 0),
vr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from vs where score > 0)"""


def _bm25(spark, d, k=10):
    return R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), k=k)


@query("agg11_bm25_topk", f"with {_BM25} select item_id, doc_id, round(score, 6) as score, rank::bigint as rank from bm where rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("agg10_corpus_stats", rf"with t as (select {_TOK} as t from documents) select count(*)::bigint as n, round(avg(len(t)), 6) as mean_length, count(distinct len(t))::bigint as lengths from t")
def corpus_stats(spark, d):
    n = F.size(T.tokens(F.col("text")))
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.countDistinct(n).alias("lengths"))


@query("top2_vector_topk", f"with {_VEC} select query_id, vec_id, round(score, 6) as score, rank::bigint as rank from vr where rank <= 10")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_topk(v, q, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("sf14_cosine_pairs", """
select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    v = table(spark, d, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return v.join(b, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query("sf15_hash_embedding", rf"""
with t as (select item_id, unnest({_TOK}) as term from benchmark), h as (select item_id, sha256(term) as h from t),
x as (select item_id, ('0x' || h[1:8])::bigint % 64 as dim, case when ('0x' || h[9:10])::bigint % 2 = 0 then 1 else -1 end as s from h),
y as (select item_id, dim, sum(s) as v from x group by all)
select item_id, dim::bigint as dim, round(v / sqrt(sum(v * v) over (partition by item_id)), 6) as value from y where v <> 0""")
def hash_embedding(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    h = F.sha2("term", 256)
    num = lambda s, n: F.conv(F.substring(h, s, n), 16, 10).cast("long")
    y = t.select("item_id", (num(1, 8) % 64).alias("dim"), F.when(num(9, 2) % 2 == 0, 1).otherwise(-1).alias("s")).groupBy("item_id", "dim").agg(F.sum("s").alias("v")).filter("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("item_id")))
    return y.select("item_id", "dim", F.round(F.col("v") / norm, 6).alias("value"))


_BY_TERM = f"""
c as (select item_id, doc_id, count(*) as score from (select item_id, unnest(list_distinct({_TOK})) as term from benchmark) join (select doc_id, unnest(list_distinct({_TOK})) as term from documents) using (term) group by 1, 2),"""

_FUSED = """
cr as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from c where score > 0),
runs as (select item_id as query_id, 0 as variant, 'bm25' as source, 1.0 as weight, doc_id, score, rank from bm where rank <= 20
  union all select item_id, 1, 'overlap', 0.8, doc_id, score, rank from cr where rank <= 20),
nm as (select *, min(score) over (partition by query_id, variant, source) as lo, max(score) over (partition by query_id, variant, source) as hi from runs),
fused as (select query_id, doc_id, sum(weight * case when variant = 0 then 1.2 else 1.0 end / (60 + rank) * (1 + 0.15 * case when hi > lo then (score - lo) / (hi - lo) when score > 0 then 1.0 else 0.0 end)) as score,
  min(rank) as best_rank from nm group by 1, 2)"""

_RUNS = f"{_BM25},{_BY_TERM}{_FUSED}"


def _by_term(spark, d, k=None):
    c = R.shared_terms(table(spark, d, "documents"), table(spark, d, "benchmark"), k=k)
    return c.select(F.col("item_id").alias("query_id"), "doc_id", F.col("shared").cast("double").alias("score"))


def _runs(spark, d):
    first = _bm25(spark, d, 20).select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant"), F.lit("bm25").alias("source"), F.lit(1.0).alias("weight"), "doc_id", "score", "rank")
    c = _by_term(spark, d, 20).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter("rank <= 20")
    second = c.select("query_id", F.lit(1).alias("variant"), F.lit("overlap").alias("source"), F.lit(0.8).alias("weight"), "doc_id", "score", "rank")
    return first.unionByName(second)


@query("agg13_weighted_fusion", f"""with {_RUNS}
select query_id, doc_id, round(score, 6) as score, best_rank::bigint as best_rank, row_number() over (partition by query_id order by round(score, 9) desc, best_rank, doc_id)::bigint as rank from fused""")
def weighted_fusion(spark, d):
    f = R.fuse(_runs(spark, d), "doc_id")
    return f.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("best_rank").cast("long").alias("best_rank"), F.col("rank").cast("long").alias("rank"))


@query("agg14_rrf", f"with {_RUNS} select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score from runs group by 1, 2")
def rrf(spark, d):
    return R.rrf(_runs(spark, d), "doc_id").select("query_id", "doc_id", F.round("score", 9).alias("score"))


@query("agg15_parent_aggregation", f"""with {_BM25}, h as (select item_id as query_id, doc_id, rank from bm where rank <= 10),
m as (select doc_id, source || '-' || doc_id // 50 as parent_id from documents),
b as (select query_id, parent_id, min(rank) as rank, arg_min(doc_id, rank) as best_chunk from h join m using (doc_id) group by 1, 2)
select query_id, parent_id, rank::bigint as rank, best_chunk, (select count(*) from m where m.parent_id = b.parent_id)::bigint as n_children from b""")
def parent_aggregation(spark, d):
    h = _bm25(spark, d).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), "rank")
    m = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws("-", "source", F.floor(F.col("doc_id") / 50).cast("string")).alias("parent_id"), F.col("doc_id").alias("position"))
    return R.parents(h, m).select("query_id", "parent_id", F.col("rank").cast("long").alias("rank"), "best_chunk", F.size("children").cast("long").alias("n_children"))


@query("sf30_local_rerank", f"""with {_BM25}, h as (select item_id as query_id, doc_id, score, rank from bm where rank <= 10),
n as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from h),
qt as (select item_id as query_id, list_distinct({_TOK}) as q from benchmark), dt as (select doc_id, list_distinct({_TOK}) as d, [lower(source)] as ti from documents)
select query_id, doc_id, round_even(least(greatest(0.40 * case when hi > lo then (score - lo) / (hi - lo) else greatest(0, least(1, score)) end
  + 0.35 * len(list_intersect(q, d)) / greatest(len(q), 1) + 0.15 * len(list_intersect(q, ti)) / greatest(len(q), 1) + 0.10 / rank, 0), 1), 6)::double as rerank_score
from n join qt using (query_id) join dt using (doc_id)""")
def local_rerank(spark, d):
    h = _bm25(spark, d).withColumnRenamed("item_id", "query_id")
    h = h.join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), "source"), "doc_id")
    return R.rerank(h, F.col("question"), F.col("body"), F.col("source")).select("query_id", "doc_id", "rerank_score")


@query("set9_diversity", f"""with {_BM25}, h as (select item_id as query_id, doc_id as item, rank, (doc_id % 3) as g from bm where rank <= 12),
dt as (select *, row_number() over (partition by query_id, g order by rank, item) as n from h),
k as (select *, row_number() over (partition by query_id order by (n > 1), rank, item) as o from dt),
c as (select * from k where o <= 5)
select query_id, item, row_number() over (partition by query_id order by rank, item)::int as place, (n > 1) as refilled from c""")
def diversity(spark, d):
    h = _bm25(spark, d, 12).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("item"), "rank", (F.col("doc_id") % 3).alias("group"))
    return R.diversify(h, 5).select("query_id", "item", "place", "refilled")


@query("set9_context_diversity", f"""with recursive {_BM25}, d as (select doc_id, coalesce(source, '') as document_id, coalesce(n_chars, 0) % 600 as seconds, ['frame_ocr', 'subtitle', 'video_segment_summary', 'text'][doc_id % 4 + 1] as channel,
  case when doc_id % 3 = 0 then 'g' || doc_id % 5 end as dup, case when doc_id % 6 = 0 then 'p' || doc_id % 2 end as parent, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\u4e00-\u9fff]|[a-zA-Z0-9_+#.-]+'), ' ') as words from documents),
e as (select *, case when words = '' then '' else sha256(words) end as hash from d),
g as (select *, document_id || ':' || channel || ':' || case when channel = 'frame_ocr' and parent is not null and dup is not null then 'parent:' || parent || ':group:' || dup else coalesce(dup, nullif(hash, '')) end as key from e),
h as (select item_id as query_id, doc_id as item, row_number() over (partition by item_id order by rank, doc_id) as rn, document_id || ':' || seconds // 120 || ':' || channel as w, channel in ('frame_ocr', 'video_segment_summary') as visual, channel = 'subtitle' as sub, hash, key from bm join g using (doc_id) where rank <= 12),
fo as (select query_id, item, rn, true as keep, case when visual then [key] else [] end as keys, case when visual then [w] else [] end as ws, case when sub then hash end as said, 1 as n from h where rn = 1
 union all select query_id, item, rn, keep, case when keep and visual then list_append(keys, key) else keys end, case when keep and visual then list_append(ws, w) else ws end, case when keep then case when sub then hash end else said end, n + keep::int from
  (select h.*, fo.keys, fo.ws, fo.said, fo.n, fo.n < 5 and not (visual and (coalesce(list_contains(fo.keys, h.key), false) or list_contains(fo.ws, h.w))) and not coalesce(sub and h.hash = fo.said, false) as keep from fo join h on h.query_id = fo.query_id and h.rn = fo.rn + 1)),
o as (select query_id, item, keep, row_number() over (partition by query_id order by keep desc, rn)::int as place from fo)
select query_id, item, place, not keep as refilled from o where place <= 5""")
def context_diversity(spark, d):
    """Reranked documents as evidences of four channels, with groups, parents and times that follow from their columns."""
    k = F.col("doc_id")
    channel = R.evidence_channel(F.get(F.array(F.lit("frame_ocr"), F.lit(""), F.lit("video_segment_summary"), F.lit("")), (k % 4).cast("int")), F.when(k % 4 == 1, "00:00:01"), F.lit("text"))
    e = table(spark, d, "documents").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("document_id"), channel.alias("channel"), (F.coalesce("n_chars", F.lit(0)) % 600).alias("seconds"), R.snippet_hash(F.col("text")).alias("text_hash"),
        F.when(k % 3 == 0, F.concat(F.lit("g"), k % 5)).alias("dup"), F.when(k % 6 == 0, F.concat(F.lit("p"), k % 2)).alias("parent"),
    )
    none = F.lit(None).cast("string")
    e = e.withColumn("group_key", R.context_group(F.col("document_id"), F.col("channel"), none, F.col("dup"), F.col("parent"), F.array().cast("array<string>"), F.col("text_hash")))
    h = _bm25(spark, d, 12).select(F.col("item_id").alias("query_id"), "doc_id", "rank").join(e, "doc_id").withColumnRenamed("doc_id", "item")
    return R.diverse_context(h, 5)


@query("agg17_retrieval_metrics", f"""with {_VEC}, h as (select query_id, vec_id as doc_id, rank from vr where rank <= 10),
j as (select q.vec_id as query_id, v.vec_id as doc_id from embeddings q join embeddings v on v.label = q.label where q.vec_id % 100 = 0),
n as (select query_id, count(*) as n from j group by 1), g as (select h.query_id, rank from h join j using (query_id, doc_id)),
a as (select query_id, min(rank) as best, count(*) filter (rank <= 1) as h1, count(*) filter (rank <= 3) as h3, count(*) filter (rank <= 5) as h5, sum(case when rank <= 5 then 1 / log2(rank + 1) else 0 end) as d5 from g group by 1),
i as (select query_id, list_sum(list_transform(range(1, least(n, 5) + 1), lambda k: 1 / log2(k + 1))) as i5 from n)
select q.query_id, case when n is not null then coalesce(1 / best, 0) end as rr, case when n is not null then coalesce(h1 / n, 0) end as recall_1, case when n is not null then coalesce(h5 / n, 0) end as recall_5, case when n is not null then round(coalesce(d5 / i5, 0), 6) end as ndcg_5
from (select distinct query_id from h) q left join n using (query_id) left join a using (query_id) left join i using (query_id)""")
def metrics(spark, d):
    """All vectors of the query's label are judgements."""
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("l"))
    hits = R.vector_topk(v, q, 10).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    rel = hits.join(q.select("query_id", "l"), "query_id").join(v.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").filter("l = label").select("query_id", "doc_id")
    counts = q.select("query_id", "l").join(v.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("n")), "l").select("query_id", "n")
    return R.retrieval_metrics(hits, rel, counts=counts).select("query_id", "rr", "recall_1", "recall_5", F.round("ndcg_5", 6).alias("ndcg_5"))
