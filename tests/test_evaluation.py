"""Edit similarity, percentiles, cue folds, block chunks, index writes and redaction against plain versions."""

from __future__ import annotations

import json
import random
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanmill.operators import evaluation, index, logs, timeline


def key(t):
    return "".join(c for c in (t or "").lower() if c.isalnum())


def test_same_question(spark):
    r = random.Random(2)
    words = ["leader", "election", "why", "how", "raft", "log", "quorum", "term"]
    pairs = [(" ".join(r.choice(words) for _ in range(4)), " ".join(r.choice(words) for _ in range(4))) for _ in range(60)]
    pairs += [("How is a leader elected?", "how is a leader elected"), ("abcdefghij", "abcdefghijk"), ("abc", "abcd"), ("", "x"), (None, "x"), ("how is the leader elected now", "how is the leader elected new")]
    got = [x["s"] for x in spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").orderBy("k").select(evaluation.same_question(F.col("a"), F.col("b")).alias("s")).collect()]

    def same(a, b):
        a, b = key(a), key(b)
        if not a or not b:
            return False
        short, long = sorted((a, b), key=len)
        return a == b or (len(short) >= 10 and short in long and len(short) / len(long) >= 0.72) or SequenceMatcher(None, a, b).ratio() >= 0.86

    assert got == [same(*p) for p in pairs] and 2 < sum(got) < len(got)


def test_safe_correction(spark):
    rows = [("machine lerning model", "machine learning model", True), ("abc", "abcdefgh", False), ("abcdef", "uvwxyz", False), ("abc", "", False)]
    got = [r["s"] for r in spark.createDataFrame(rows, "a string, b string, w boolean").select(evaluation.safe_correction(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [w for *_, w in rows]


def test_alike_decides_as_difflib():
    r = random.Random(4)
    pairs = [("", ""), ("a", ""), ("aé中𝄞" * 9, "𝄞aé中" * 9)]
    for _ in range(400):
        letters = r.choice(["ab", "abc", "abcdefgh ", "aé中b𝄞"])
        a = [r.choice(letters) for _ in range(r.randint(0, 70))]
        b = [r.choice(letters) if r.random() < 0.2 else c for c in a if r.random() < 0.9]
        pairs += [("".join(a), "".join(b)), ("".join(a), "".join(reversed(a)))]
    for a, b in pairs:
        ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert all(evaluation._alike(a, b, least) == (ratio >= least) for least in (0.55, 0.82, 0.86, ratio)), (a, b)


def test_alike_is_quick_on_long_texts():
    """Texts of 3,000 letters, changed all over: ten times as fast as difflib's blocks, and no row that needs no ratio is compared."""
    r = random.Random(5)
    a = "".join(r.choice("etaoin shr") for _ in range(3000))
    for b in (a[::-1], a.replace("e", "a")):
        began = time.perf_counter()
        want = SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.55
        plain, began = time.perf_counter() - began, time.perf_counter()
        assert evaluation._alike(a, b, 0.55) == want and time.perf_counter() - began < plain / 2


@pytest.mark.parametrize("n", [1, 2, 7, 30_000])
def test_percentiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(50, n), 2 if n < 100 else 1)
    df = spark.createDataFrame([(k % 2, float(v)) for k, v in enumerate(values)] + [(0, None)], "k int, v double")
    for r in evaluation.percentiles(df, "k", "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}).collect():
        own = values[r["k"] :: 2]
        assert np.allclose([r["p0"], r["p50"], r["p95"], r["p100"]], np.percentile(own, [0, 50, 95, 100]))


def test_merged_cues(spark):
    rows = [(1, 0.0, 3.0, "Hello there"), (1, 1.0, 3.0, "hello"), (1, 9.0, 9.1, "hello"), (1, 9.0, 12.0, ""), (1, 9.5, 12.0, ""), (2, 0.0, 1.0, "Hello there")]
    got = timeline.merged_cues(spark.createDataFrame(rows, "document_id long, start double, end double, text string")).collect()
    assert sorted((r["document_id"], r["cue"], r["start"], r["end"], r["text"]) for r in got) == [(1, 1, 0.0, 3.0, "Hello there"), (1, 2, 9.0, 9.2, "hello"), (1, 3, 9.0, 12.0, ""), (1, 4, 9.5, 12.0, ""), (2, 1, 0.0, 1.0, "Hello there")]


def test_block_chunks(spark):
    long = " ".join(f"word{k}." for k in range(400))
    rows = [(1, 0, "text", None, "before"), (1, 1, "heading", None, "## Raft:"), (1, 2, "table", None, long), (1, 3, "text", "Own", long), (1, 4, "text", None, " "), (1, 5, "text", None, "after"), (2, 0, "text", None, "other")]
    got = index.block_chunks(spark.createDataFrame(rows, "document_id long, place int, block_type string, section_title string, text string")).orderBy("document_id", "position").collect()
    one = [r for r in got if r["document_id"] == 1]
    assert [r["chunk_id"] for r in one] == [f"1-{k}" for k in range(len(one))]
    assert [r["section"] for r in one][:4] == ["全文", "Raft:", "Raft:", "Own"] and one[-1]["section"] == "Own" and one[-1]["text"] == "after"
    assert one[2]["text"] == long and all(len(r["text"]) <= 700 + 90 for r in one[3:]) and len(one) > 6
    assert (got[-1]["section"], got[-1]["position"]) == ("全文", 0)


def test_index_write_replaces_documents(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "document_id long, text string")
    path = str(tmp_path / "index")
    index.write(make([(1, "a"), (1, "b"), (2, "c"), (3, "d")]), path, 2)
    index.write(make([(1, "x"), (4, "y")]), path, 2)
    assert sorted((r["document_id"], r["text"]) for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "c"), (3, "d"), (4, "y")]


def test_redaction(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}
    given = [json.dumps({"user": 1, "x_TOKEN": "t", "list": [{"password": "p", "k": "v"}] * 60, "jd": "j", "long": "y" * 600, "n": None}), json.dumps(deep), "no json", "[1]", None]
    got = [r["c"] for r in spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, c string").orderBy("k").select(logs.redacted(F.col("c")).alias("c")).collect()]
    first = json.loads(got[0])
    assert first["x_TOKEN"] == first["jd"] == "***" and len(first["list"]) == 50 and first["list"][0] == {"password": "***", "k": "v"} and len(first["long"]) == 500 and first["n"] is None
    assert "truncatedDepth" in got[1] and got[2] == got[3] == '{"serializationError":true}' and got[4] is None
