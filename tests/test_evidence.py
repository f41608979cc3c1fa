"""Evidence rules by hand: every reason of the answer guard, snippet quality, variants and projections."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import evidence as E

GOOD = "A long snippet that says how the leader of a cluster is elected by its members and why it stays in office until it fails again."


def admitted(spark, score=0.6, snippet=GOOD, question="leader elected cluster", summary_only=False, located=False, candidates=5, filtered=5, removed=0):
    q = spark.createDataFrame([(1, question, [], candidates, filtered, removed)], "query_id long, question string, variants array<string>, candidates int, filtered int, removed int")
    rows = [] if score is None else [(1, 1, score, "notes", "all", snippet, summary_only, located)]
    e = spark.createDataFrame(rows, "query_id long, rank int, score double, title string, section string, snippet string, summary_only boolean, located boolean")
    return E.admission(q, e).first()


@pytest.mark.parametrize(
    ("given", "reason"),
    [
        ({}, None), ({"candidates": 0}, "NO_EVIDENCE"), ({"filtered": 0}, "FILTERED_OUT"), ({"score": None}, "LOW_CONFIDENCE"), ({"summary_only": True}, "ONLY_DIAGNOSTIC_CANDIDATES"), ({"snippet": "short"}, "WEAK_SNIPPET"),
        ({"score": 0.1}, "LOW_CONFIDENCE"), ({"score": 0.21}, None), ({"score": 0.21, "question": "unknown words here"}, "LOW_CONFIDENCE"), ({"question": "zebra quartz"}, "INSUFFICIENT_COVERAGE"),
    ],
)
def test_admission(spark, given, reason):
    got = admitted(spark, **given)
    assert (got["reason"], got["status"]) == (reason, "REFUSED" if reason else "ANSWERED")


def test_admission_score(spark):
    got = admitted(spark)  # one candidate: full top score; all words covered; support; quality 1; local rerank costs .08
    assert (got["confidence"], got["supporting"]) == (0.92, 1)
    assert admitted(spark, removed=1)["confidence"] == 0.87


def test_snippet_quality(spark):
    cases = {None: 0.0, "": 0.0, "目录": 0.0, "# - ": 0.0, "abcdefghij": round(10 / 80 * 0.35, 6), "x" * 200: 1.0, "目录 第一章 原理与机制的说明文字": round(15 / 80 * 0.3, 6), "00:01:02 00:01:03 ab": round(14 / 80 * 0.35, 6)}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", E.snippet_quality(F.col("t")).alias("q")).collect()
    assert {r["t"]: r["q"] for r in got} == cases


def test_variants(spark):
    texts = ["1. “Raft 是什么”", "怎么做", "", "plain words"]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.variants(F.col("t")).alias("v")).collect()]
    assert got[0] == ["“Raft 是什么", "“Raft 是什么 核心概念 原理", "“Raft 是什么 关键步骤 公式 示例", "“Raft 是什么 易混点 对比 总结"]
    assert got[1][1] == "怎么做 步骤 方法" and got[2] == [] and len(got[3]) == 4


def test_public_values(spark):
    row = spark.range(1).select(
        E.public_metadata(F.array(F.lit("source_path"), F.lit("playURL"), F.lit("note")), F.array(F.lit("/srv/x"), F.lit(" https://a.b/c "), F.lit("/srv/x"))).alias("m"),
        E.metadata_view(F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("2"), F.lit("z"), F.lit("9")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), ("a", "b")).alias("v"),
    ).first()
    assert row["m"] == {"playURL": "https://a.b/c", "note": "/srv/x"} and row["v"] == {"a": "1", "b": "2"}
