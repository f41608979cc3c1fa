"""Retrieval over a batch of questions: postings, BM25, vectors, fusion, parents, reranking and diversity.

All questions of a batch run as one plan. Postings, statistics and question terms meet in equi-joins on the term.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, coverage, tokens

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Fusion:
    """Bounded settings of the weighted reciprocal-rank fusion."""

    k: int = 60
    blend: float = 0.15
    original: float = 1.2

#: Channels whose evidences crowd a context, and the tokens of a snippet.
VISUAL_CHANNELS = ("frame_ocr", "video_segment_summary")
#: Stands for a term that every document has; no token is empty.
EVERY = ""
SNIPPET_TOKEN = "[\u4e00-\u9fff]|[a-zA-Z0-9_+#.-]+"


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length)."""
    terms = docs.select(key, tokens(F.col(text)).alias("t"))
    return terms.select(key, F.size("t").cast("long").alias("length"), F.explode("t").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def asked_terms(queries: DataFrame, text: str = "text", query_id: str = "item_id") -> DataFrame:
    """(query_id, term, times)."""
    return queries.select(query_id, F.explode(tokens(F.col(text))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("times"))


def asked_postings(docs: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, length, term, tf) of the terms that questions have, dealt by key, so that what follows by key needs no shuffle.

    Other terms go before anything is shuffled or counted. Each document also has the term EVERY once, so that statistics
    of all documents need no second pass over the texts.
    """
    raw = docs.select(key, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)).alias("t"))
    each = raw.select(key, F.size("t").cast("long").alias("length"), F.explode(F.concat("t", F.array(F.lit(EVERY)))).alias("term")).withColumn("term", F.lower("term"))
    kept = asked.select("term").unionByName(asked.sparkSession.range(1).select(F.lit(EVERY).alias("term"))).distinct()
    return each.join(kept, "term", "left_semi").repartition(key).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def matches(held: DataFrame, asked: DataFrame, key: str = "doc_id", query_id: str = "item_id", k: int | None = None) -> DataFrame:
    """(key, query_id, n, value, asked) of documents and questions with a common term: n terms in common, value the sum of the
    terms' x times their times in the question, asked the question's distinct terms.

    held: (key, term, x), a term once for each document, dealt by key; terms that no question has are let through to here. A document's terms become one row; a block of at most
    MOST_QUERIES questions travels to the documents, whose terms meet the questions' lists in arrays of bounded size. With k
    only each batch's k best by value (nine decimals), then key, with a value above 0 come out, which hold the best of all.
    """
    docs = held.groupBy(key).agg(F.collect_list(F.struct("term", "x")).alias("terms"))
    n = max(1, -(-asked.select(query_id).distinct().count() // MOST_QUERIES))
    parts = [_block_matches(docs, asked.filter(F.pmod(F.xxhash64(query_id), F.lit(n)) == b) if n > 1 else asked, key, query_id, k) for b in range(n)]
    return reduce(DataFrame.unionByName, parts)


def _block_matches(docs: DataFrame, asked: DataFrame, key: str, query_id: str, k: int | None) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    block = asked.select(query_id, "term", "times").orderBy("term").toArrow().combine_chunks()  # a block of bounded size
    names, terms = (pc.dictionary_encode(pa.concat_arrays(block.column(c).chunks) if block.num_rows else pa.array([], block.schema[c].type), null_encoding="encode") for c in (0, 1))
    vocabulary, which = terms.dictionary, terms.indices.to_numpy()
    starts = np.searchsorted(which, np.arange(len(vocabulary) + 1))
    ids, asking, times = names.dictionary, names.indices.to_numpy(), block.column(2).to_numpy()
    sizes = np.bincount(asking, minlength=len(ids))
    shared = asked.sparkSession.sparkContext.broadcast((vocabulary, starts, asking, times, ids, sizes))

    def run(batches):
        vocabulary, starts, asking, times, ids, sizes = shared.value
        wide = max(1, len(ids))
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
            lists = batch.column(1)
            flat, doc = lists.flatten(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            term = pc.index_in(flat.field(0), value_set=vocabulary).fill_null(-1).to_numpy()
            x = flat.field(1).to_numpy(zero_copy_only=False)[term >= 0]
            doc, term = doc[term >= 0], term[term >= 0]
            many = starts[term + 1] - starts[term]
            step = max(1, CELLS // wide)
            for low in range(0, batch.num_rows, step):
                a, b = np.searchsorted(doc, (low, low + step))
                count = many[a:b]
                place = np.arange(count.sum()) + np.repeat(starts[term[a:b]] - np.cumsum(count) + count, count)
                cell = np.repeat((doc[a:b] - low) * wide, count) + asking[place]
                size = min(step, batch.num_rows - low) * wide
                met, value = np.bincount(cell, minlength=size), np.bincount(cell, np.repeat(x[a:b], count) * times[place], size).astype(np.float64)  # whole numbers of no weights
                at = np.flatnonzero(met)
                if k is not None:
                    at = at[value[at] > 0]
                    order = np.lexsort((at, -np.round(value[at], 9), at % wide))
                    own = at[order] % wide
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    at = at[order][np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own))) < k]
                q = at % wide
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at // wide + low)), ids.take(pa.array(q)), pa.array(met[at]), pa.array(value[at]), pa.array(sizes[q])], names=[key, query_id, "n", "value", "asked"])

    of = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    return docs.mapInArrow(run, f"{of(docs, key)}, {of(asked, query_id)}, n long, value double, asked long")


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_id: str = "item_id", k: int = 10) -> DataFrame:
    """The top k of every question: (query_id, key, score, rank). A term that a question repeats counts repeatedly.

    Statistics cover the documents given; ties go to the smaller key. Postings are reduced to the questions' terms before
    anything is shuffled, documents meet questions where their postings are, and only the best of a batch leave it.
    """
    asked = asked_terms(queries, "text", query_id)
    p = asked_postings(docs, asked, key, text)
    own = F.when(F.col("term") == EVERY, F.col("tf"))  # no filter, which would be pushed into a read of its own
    stats = p.agg(F.sum(own).alias("n"), F.greatest(F.sum(own * F.col("length")) / F.sum(own), F.lit(1.0)).alias("mean"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    scored = p.join(df, "term").join(F.broadcast(stats))  # stats: one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hits = matches(scored.select(key, "term", weight.alias("x")), asked, key, query_id, k).select(query_id, key, F.col("value").alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), key))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def term_matches(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_id: str = "item_id") -> DataFrame:
    """(query_id, key, n_terms, tf) of every question and document with n_terms distinct terms in common, which the document has tf times."""
    asked = asked_terms(queries, "text", query_id)
    own = asked_postings(docs, asked, key, text).groupBy(key, "term").agg(F.sum("tf").cast("double").alias("x"))
    found = matches(own, asked.withColumn("times", F.lit(1).cast("long")), key, query_id)
    return found.select(query_id, key, F.col("n").alias("n_terms"), F.col("value").cast("long").alias("tf"))


def shared_terms(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_id: str = "item_id", k: int | None = None) -> DataFrame:
    """(query_id, key, shared, coverage) of every question and document that share a term; all other pairs have coverage 0.

    Distinct terms meet where the documents' postings are, so no pair without a common term is a row. Both keys are unique.
    With k the rows hold the k pairs of each question that share most, ties by the smaller key, and some others.
    """
    asked = asked_terms(queries, "text", query_id)
    own = asked_postings(docs, asked, key, text).groupBy(key, "term").agg((F.max("length") > 0).cast("double").alias("x"))  # 1; so the postings are those of bm25
    found = matches(own, asked.withColumn("times", F.lit(1).cast("long")), key, query_id, k)
    return found.select(query_id, key, F.col("n").alias("shared"), (F.col("n") / F.col("asked")).alias("coverage"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top k of every query: vectors (vec_id, embedding), queries (query_id, embedding).

    Queries are dealt by a hash of their id to blocks of about MOST_QUERIES at most. A block travels with each batch
    of vectors as one matrix, all vectors meet all blocks; each task keeps the k best of a query, compares at most CELLS
    pairs at once, and a window merges what the tasks have kept.
    """
    asked = queries.select("query_id", "embedding")
    n = max(1, -(-asked.count() // MOST_QUERIES))
    parts = [_block_topk(vectors, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else asked, k) for b in range(n)]
    found = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _block_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each task's vectors for each query of one block."""
    import numpy as np
    import pyarrow as pa

    rows = queries.collect()  # a block of bounded size
    ids = np.array([r["query_id"] for r in rows], np.int64)
    q = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    shared = queries.sparkSession.sparkContext.broadcast((ids, q))

    def best_of(score, key, of, at, low):
        """The k best of each query among the scores at (query, key) that are not below what it has (low), and the best so far."""
        of = np.concatenate([of, np.repeat(np.arange(len(low)), k)])
        key, score = np.concatenate([key, at[0].ravel()]), np.concatenate([score, at[1].ravel()])
        order = np.lexsort((key, -np.round(score, 9), of))
        chosen = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < k]
        return key[chosen].reshape(-1, k), score[chosen].reshape(-1, k)

    def run(batches):
        names, m = shared.value
        keys, scores = np.zeros((len(names), k), np.int64), np.full((len(names), k), -np.inf)
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            key = batch.column(0).to_numpy()
            v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
            step = max(1, CELLS // batch.num_rows)
            for a in range(0, len(names), step):  # a bounded number of scores at a time
                s = m[a : a + step] @ v
                low = np.maximum(scores[a : a + step].min(axis=1), 0.0)
                if np.count_nonzero(s >= low[:, None]) > 4 * k * len(s) and s.shape[1] > k:
                    low = np.maximum(low, np.partition(s, -k, axis=1)[:, -k])
                of, which = np.nonzero(s >= low[:, None] - 2e-9)  # what may be equal by nine decimals stays
                keys[a : a + step], scores[a : a + step] = best_of(s[of, which], key[which], of, (keys[a : a + step], scores[a : a + step]), low)
        found = scores > 0
        at = np.nonzero(found)[0]
        for a in range(0, len(at), MOST_QUERIES):
            b = slice(a, a + MOST_QUERIES)
            yield pa.RecordBatch.from_arrays([pa.array(names[at[b]]), pa.array(keys[found][b]), pa.array(scores[found][b])], names=["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double").filter("score > 0")


#: Questions of a block, and pairs of questions and documents or vectors that are in memory at once.
MOST_QUERIES, CELLS = 20_000, 1 << 21


def scaled(score: Column, group: list[str], tie: str) -> Column:
    """Min-max within a group. If all are equal: 'positive' gives 1 above 0 and else 0, 'clamp' the clamped score, 'one' 1."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    equal = {"positive": F.when(score > 0, 1.0).otherwise(0.0), "clamp": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), "one": F.lit(1.0)}[tie]
    return F.when(high > low, (score - low) / (high - low)).otherwise(equal)


def rrf(runs: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Equal-weight fusion of runs (query_id, key, rank)."""
    return runs.groupBy("query_id", key).agg(F.sum(1 / (F.lit(max(1, int(k))) + F.col("rank"))).alias("score"))


def contributions(runs: DataFrame, settings: Fusion = Fusion()) -> DataFrame:
    """What each hit of runs (query_id, variant, source, weight, score, rank, ...) gives its document; variant 0 is the question itself."""
    norm = scaled(F.col("score"), ["query_id", "variant", "source"], "positive")
    weight = F.col("weight") * F.when(F.col("variant") == 0, settings.original).otherwise(1.0)
    return runs.withColumn("contribution", weight / (settings.k + F.col("rank")) * (1 + settings.blend * norm))


def fuse(runs: DataFrame, key: str, settings: Fusion = Fusion()) -> DataFrame:
    """Weighted fusion of runs (query_id, variant, source, weight, key, score, rank). Order: score down, best rank, key."""
    fused = contributions(runs, settings).withColumnRenamed("contribution", "part").groupBy("query_id", key).agg(F.sum("part").alias("score"), F.min("rank").alias("best_rank"), F.sort_array(F.collect_set("source")).alias("sources"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "best_rank", key))
    return fused.withColumn("rank", place)


def parents(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, rank) become their parents; all children are listed, the best hit speaks for them.

    members: (chunk_id, parent_id, position).
    """
    best = hits.join(members, "chunk_id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("rank"), F.min_by("chunk_id", "rank").alias("best_chunk"))
    children = members.join(best.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id"))).alias("c"))
    return best.join(children, "parent_id").select("query_id", "parent_id", "rank", "best_chunk", F.col("c.chunk_id").alias("children"))


def rerank(hits: DataFrame, question: Column, body: Column, title: Column) -> DataFrame:
    """.40 fused score (min-max) + .35 coverage of the text + .15 of the title + .10 / rank, six decimals."""
    base = scaled(F.col("score"), ["query_id"], "clamp")
    q = tokens(question)
    score = 0.40 * base + 0.35 * coverage(q, tokens(body)) + 0.15 * coverage(q, tokens(title)) + 0.10 / F.col("rank")
    out = hits.withColumn("rerank_score", F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6))
    return out.withColumn("rerank_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")))


def diversify(hits: DataFrame, top_k: int, per_group: int = 1) -> DataFrame:
    """Per question, in rank order: at most per_group of a group, then the skipped ones refill up to top_k.

    hits: (query_id, item, group, rank).
    """
    of_group = F.row_number().over(Window.partitionBy("query_id", "group").orderBy("rank", "item"))
    spare = hits.withColumn("refilled", of_group > per_group)
    chosen = spare.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("refilled", "rank", "item"))).filter(F.col("_n") <= top_k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item"))
    return chosen.select("query_id", "item", "rank", place.alias("place"), "refilled")


def evidence_channel(channel: Column, start: Column, block_type: Column) -> Column:
    """The channel that an evidence names, else one told by whether it has a time and is a picture."""
    timed = F.coalesce(start, F.lit("")) != ""
    return F.when(channel != "", channel).when(timed & (block_type == "image"), "frame_ocr").when(timed, "subtitle").otherwise("text")


def snippet_hash(text: Column) -> Column:
    """Of the lower-cased words and single Chinese characters; empty if there is none."""
    tokens = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(SNIPPET_TOKEN), F.lit(0)), " ")
    return F.when(tokens == "", "").otherwise(F.sha2(tokens, 256))


def context_group(document: Column, channel: Column, occurrence: Column, group: Column, parent: Column, frame_groups: Column, text_hash: Column) -> Column:
    """What evidences of a channel repeat each other by: a frame's occurrence, its group in a parent, a group, the groups of its frames, or its words."""
    head, frame = F.concat_ws(":", document.cast("string"), channel), channel == "frame_ocr"
    named = lambda *parts: F.concat_ws(":", head, *parts)
    own = F.when(frame & (occurrence != ""), named(F.lit("occurrence"), occurrence)).when(frame & (parent != "") & (group != ""), named(F.lit("parent"), parent, F.lit("group"), group)).when(group != "", named(group))
    return F.coalesce(own, F.when(F.size(frame_groups) > 0, named(F.array_join(frame_groups, ","))), F.when(text_hash != "", named(text_hash)))


def diverse_context(hits: DataFrame, top_k: int, per_window: int = 1, window: int = 120) -> DataFrame:
    """(query_id, item, place, refilled): what a question's context takes from its reranked evidences, in order of rank.

    hits: (query_id, item, rank, document_id, channel, seconds, group_key, text_hash), an item once for each question. A frame
    or summary is passed over if its group was taken, or per_window of its document, channel and window of seconds were; a
    subtitle if the last one taken was a subtitle of the same words. If fewer than top_k are taken, those passed over
    follow by rank. A null group or time (0) holds nothing back by group. What was taken decides, so a question's
    evidences, a bounded list, are one array, folded natively; questions are independent.
    """
    visual = F.col("channel").isin(*VISUAL_CHANNELS)
    of_window = F.concat_ws(":", F.col("document_id").cast("string"), F.floor(F.coalesce("seconds", F.lit(0)) / window).cast("string"), "channel")
    hit = F.struct("rank", "item", F.when(visual, F.col("group_key")).alias("group"), F.when(visual, of_window).alias("window"), F.when(F.col("channel") == "subtitle", F.col("text_hash")).alias("said"))
    asked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))

    def step(taken: Column, h: Column) -> Column:
        same_group = F.exists(taken, lambda x: x["group"] == h["group"])
        in_window = F.size(F.filter(taken, lambda x: x["window"] == h["window"]))
        repeats = F.get(taken, F.size(taken) - 1)["said"] == h["said"]
        held = (F.size(taken) >= top_k) | F.coalesce(same_group, F.lit(False)) | (in_window >= per_window) | F.coalesce(repeats, F.lit(False))
        return F.when(held, taken).otherwise(F.concat(taken, F.array(h)))

    chosen = asked.withColumn("taken", F.aggregate("hits", F.slice("hits", 1, 0), step)).withColumn("n", F.size("taken"))
    rest = F.filter("hits", lambda h: ~F.exists("taken", lambda x: x["item"] == h["item"]))
    context = F.concat("taken", F.slice(rest, F.lit(1), F.greatest(F.lit(top_k) - F.col("n"), F.lit(0))))
    return chosen.select("query_id", "n", F.posexplode(context).alias("k", "h")).select("query_id", "h.item", (F.col("k") + 1).alias("place"), (F.col("k") >= F.col("n")).alias("refilled"))


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (1, 3, 5), counts: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank, recall and NDCG per question over documents as first seen; null without judgements.

    hits: (query_id, doc_id, rank); qrels: (query_id, doc_id). Where the judgements are too many to be pairs, counts
    (query_id, n) gives their number and qrels need only hold those among the hits.
    """
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))
    good = placed.join(qrels.distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(
        F.min("place").alias("best"), *[F.count_if(F.col("place") <= k).alias(f"hit{k}") for k in cuts], *[F.sum(F.when(F.col("place") <= k, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias(f"dcg{k}") for k in cuts]
    )
    n = qrels.distinct().groupBy("query_id").agg(F.count("*").alias("n")) if counts is None else counts
    out = hits.select("query_id").distinct().join(n, "query_id", "left").join(good, "query_id", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    known = lambda c: F.when(F.col("n").isNotNull(), F.coalesce(c, F.lit(0.0)))
    return out.select("query_id", known(1 / F.col("best")).alias("rr"), *[known(F.col(f"hit{k}") / F.col("n")).alias(f"recall_{k}") for k in cuts], *[F.round(known(F.col(f"dcg{k}") / F.when(F.col("n") > 0, ideal(k))), 9).alias(f"ndcg_{k}") for k in cuts])
