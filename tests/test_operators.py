"""Small cases that can be checked by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gleanmill.functions import text as T
from gleanmill.operators import chunking, filters, retrieval, review, sampling, timeline


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


def test_tokens_of_mixed_scripts(spark):
    assert one(spark, T.tokens(F.col("t")), t="学习 C++ and Node.js") == ["学", "习", "c++", "and", "node.js"]


def test_unicode_space(spark):
    assert one(spark, T.collapsed(F.col("t")), t=" a　b\n c ") == "a b c"


@pytest.mark.parametrize(("clock", "sec"), [("01:02:03", 3723), ("02:03", 123), ("00:00:01,500", 1), ("x", 0)])
def test_seconds(spark, clock, sec):
    assert one(spark, T.seconds(F.col("t")), t=clock) == sec


def test_masks_and_frames(spark):
    assert one(spark, T.masked_variables(F.col("t")), t="id 12345 of 123e4567-e89b-12d3-a456-426614174000 in 99") == "id {num} of {uuid} in 99"
    assert one(spark, T.top_frame(F.col("t"), "app/"), t="boom\n at lib/x\n at app/y") == "at app/y"


def test_filters_drop_unknown_keys_and_empty_values():
    own, system, ignored = filters.plan({"lang": " en ", "source": ["", "a"], "x": 1, "userId": 7}, {"lang", "source"}, {"userId"})
    assert (own, system, ignored) == ({"lang": ["en"], "source": ["a"]}, {"userId": ["7"]}, ["x"])
    assert filters.tenant_scope({"userId": "evil", "lang": " en", "other": 1}, "me", {"lang", "userId"}) == {"lang": ["en"], "userId": ["me"], "visibilityScope": ["private"]}


def test_metrics_with_repeats(spark):
    hits = spark.createDataFrame([(1, d, k) for k, d in enumerate(["d1", "d2", "d2", "d3", "d4"], 1)] + [(2, "d9", 1)], "query_id long, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "d2"), (1, "d4")], "query_id long, doc_id string")
    got = {r["query_id"]: r for r in retrieval.retrieval_metrics(hits, qrels).collect()}
    assert (got[1]["rr"], got[1]["recall_1"], got[1]["recall_3"], got[1]["recall_5"]) == (0.5, 0, 0.5, 1)
    assert got[1]["ndcg_5"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert got[2]["rr"] is None


def test_diversity_refills(spark):
    hits = spark.createDataFrame([(1, i, g, r) for i, g, r in ((10, 0, 1), (11, 0, 2), (12, 1, 3))], "query_id long, item long, group int, rank int")
    assert [(r["item"], r["refilled"]) for r in retrieval.diversify(hits, 3).orderBy("place").collect()] == [(10, False), (11, True), (12, False)]
    assert [r["item"] for r in retrieval.diversify(hits, 2).orderBy("place").collect()] == [10, 12]


def test_chunks_are_bounded_and_whole():
    text = "\n\n".join(f"part {k} " + "word " * 30 for k in range(9))
    parts = chunking.split(text, 180, 20)
    assert len(parts) > 2
    assert max(map(len, parts)) <= 220
    assert chunking.split("", 10, 2) == []
    assert chunking.split("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]


def test_segments_reset(spark):
    cues = spark.createDataFrame([(1, k, s, s + 5) for k, s in enumerate([0, 10, 20, 30, 40, 50, 60, 119, 300])], "document_id long, cue long, start long, end long")
    assert [r["segment"] for r in timeline.segments(cues).orderBy("cue").collect()] == [0] * 6 + [1, 1, 2]


def test_overlap_join_gives_each_pair_once(spark):
    left = spark.createDataFrame([(1, 0, 1000)], "k int, s long, e long")
    right = spark.createDataFrame([(1, 100, 900), (1, 1000, 1100), (2, 0, 10)], "k int, rs long, re long")
    assert [(r["rs"], r["re"]) for r in timeline.overlap_join(left, right, ["k"], 120).collect()] == [(100, 900)]


def test_frame_clusters(spark):
    frames = spark.createDataFrame([(1, 0, 0, "the same long slide text"), (1, 1, 60, "the same long slide text!"), (1, 2, 120, "another slide altogether"), (1, 3, 900, "the same long slide text")], "document_id long, frame long, second long, text string")
    assert [r["cluster"] for r in timeline.frame_clusters(frames).orderBy("frame").collect()] == [0, 0, 1, 2]


def test_even_sample_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(1, k) for k in range(10)], "g int, k int")
    assert sorted(r["k"] for r in sampling.evenly_spaced(rows, ["g"], ["k"], 3).collect()) == [0, 4, 9]
    assert [r["k"] for r in sampling.evenly_spaced(rows, ["g"], ["k"], 1).collect()] == [5]


def test_stale_versions_lose(spark):
    rows = spark.createDataFrame([("a", 2, "new"), ("a", 1, "old"), ("b", 1, "x")], "k string, v int, t string")
    assert sorted((r["k"], r["t"]) for r in review.latest_version(rows, "k", "v").collect()) == [("a", "new"), ("b", "x")]


def test_shared_terms_reach_all_pairs(spark):
    words = lambda k: {f"w{k % m}" for m in (2, 3, 5, 7)}
    items, docs = {k: words(k) for k in range(90)}, {k: words(3 * k + 1) for k in range(60)}
    frame = lambda x, key: spark.createDataFrame([(k, " ".join([*sorted(w), *w]) if w else None) for k, w in x.items()], f"{key} long, text string")
    got = {(r["item_id"], r["doc_id"]): (r["shared"], r["coverage"]) for r in retrieval.shared_terms(frame({**docs, 999: set()}, "doc_id"), frame({**items, 998: set()}, "item_id")).collect()}
    assert got == {(i, d): (len(a & b), len(a & b) / len(a)) for i, a in items.items() for d, b in docs.items() if a & b}


def test_vector_topk_takes_any_number_of_queries(spark, monkeypatch):
    frame = lambda key, ids: spark.createDataFrame([(k, [math.sin(k), math.cos(k), 1.0]) for k in ids], f"{key} long, embedding array<double>")
    ask = lambda: sorted(map(tuple, retrieval.vector_topk(frame("vec_id", range(50)), frame("query_id", range(0, 90, 3)), 4).select("query_id", "vec_id", "rank").collect()))
    whole = ask()
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 7)
    assert ask() == whole and len(whole) == 30 * 4


def test_diverse_context(spark):
    frame, sub, text = "frame_ocr", "subtitle", "text"
    rows = [
        (1, 10, 1, 7, frame, 5, "a", "h1"), (1, 11, 2, 7, frame, 300, "a", "h2"), (1, 12, 3, 7, frame, 119, "b", "h3"), (1, 13, 4, 7, frame, 120, "b", "h3"), (1, 14, 5, 7, sub, 1, "c", "same"), (1, 15, 6, 7, sub, 2, "c", "same"),
        (1, 16, 7, 7, text, 0, "c", "same"), (1, 17, 8, 7, sub, 3, "c", "same"), (1, 18, 9, 7, frame, 500, None, "h4"), (1, 19, 10, 8, frame, 5, None, "h5"),
        (2, 10, 1, 7, frame, 5, "a", "h1"), (2, 11, 2, 7, frame, 6, "b", "h2"), (2, 12, 3, 8, sub, None, None, ""), (2, 13, 4, 8, sub, None, None, ""),
    ]
    df = spark.createDataFrame(rows, "query_id long, item long, rank int, document_id long, channel string, seconds int, group_key string, text_hash string")
    got = lambda k, **kw: {q: [(r["item"], r["refilled"]) for r in retrieval.diverse_context(df, k, **kw).filter(f"query_id = {q}").orderBy("place").collect()] for q in (1, 2)}
    five = got(5)
    assert five[1] == [(10, False), (13, False), (14, False), (16, False), (17, False)]  # 11: group, 12: window, 15: the words just said
    assert five[2] == [(10, False), (12, False), (11, True), (13, True)]  # those passed over follow
    assert [i for i, _ in got(20)[1]] == [10, 13, 14, 16, 17, 18, 19, 11, 12, 15]
    assert got(3, per_window=2)[2] == [(10, False), (11, False), (12, False)]
    assert retrieval.diverse_context(df.filter("false"), 5).count() == 0


def test_context_groups(spark):
    rows = [("frame_ocr", "o", "g", "p", [], "h"), ("frame_ocr", None, "g", "p", [], "h"), ("subtitle", "o", "g", "p", ["x"], "h"), ("text", None, None, None, ["x", "y"], "h"), ("text", None, "", None, [], "h"), ("text", None, None, None, None, "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c string, o string, g string, p string, f array<string>, h string")
    keys = df.orderBy("k").select(retrieval.context_group(F.lit(3), *[F.col(x) for x in "cogpfh"]).alias("x")).collect()
    assert [r["x"] for r in keys] == ["3:frame_ocr:occurrence:o", "3:frame_ocr:parent:p:group:g", "3:subtitle:g", "3:text:x,y", "3:text:h", None]
    told = spark.createDataFrame([("own", "", ""), (None, "00:01", "image"), ("", "00:01", None), (None, None, "image")], "c string, s string, b string")
    assert [r["x"] for r in told.select(retrieval.evidence_channel(F.col("c"), F.col("s"), F.col("b")).alias("x")).collect()] == ["own", "frame_ocr", "subtitle", "text"]
