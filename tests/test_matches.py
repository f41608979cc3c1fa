"""Documents against questions by their terms: every pair, the best of each question, odd inputs and small blocks."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from gleanmill.operators import retrieval as R
from gleanmill.plans import catalog

TOKEN = re.compile("[一-鿿]|[a-zA-Z0-9_+#.-]+")
DOCS = [("d1", "Raft log, raft LEADER"), ("d2", "a log of logs"), ("d3", None), ("d4", ""), ("d5", "索引 index 索"), ("d6", "Raft log, raft LEADER"), ("d7", "nothing here"), ("d8", "log log log 索引")]
ASKED = [(1, "raft log log"), (2, "索引?"), (3, "unknown"), (4, None), (5, "LOG leader")]


def words(t):
    return [w.lower() for w in TOKEN.findall(t or "")]


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string"), spark.createDataFrame(ASKED, "item_id int, text string")


@pytest.mark.parametrize(("most", "cells"), [(20_000, 1 << 21), (2, 3)])
def test_every_pair(tables, monkeypatch, most, cells):
    monkeypatch.setattr(R, "MOST_QUERIES", most)
    monkeypatch.setattr(R, "CELLS", cells)
    want = {(q, d): (len(set(words(a)) & set(words(t))), sum(words(t).count(w) for w in set(words(a)))) for q, a in ASKED for d, t in DOCS if set(words(a)) & set(words(t))}
    got = R.term_matches(*tables).collect()
    assert {(r["item_id"], r["doc_id"]): (r["n_terms"], r["tf"]) for r in got} == want and len(got) == len(want)
    shared = R.shared_terms(*tables).collect()
    size = {q: len(set(words(a))) for q, a in ASKED}
    assert {(r["item_id"], r["doc_id"]): (r["shared"], r["coverage"]) for r in shared} == {p: (n, n / size[p[0]]) for p, (n, _) in want.items()}


@pytest.mark.parametrize(("most", "cells", "k"), [(20_000, 1 << 21, 10), (2, 3, 1), (2, 3, 2)])
def test_bm25_against_plain(tables, monkeypatch, most, cells, k):
    from math import log

    monkeypatch.setattr(R, "MOST_QUERIES", most)
    monkeypatch.setattr(R, "CELLS", cells)
    held = {d: Counter(words(t)) for d, t in DOCS}
    df, mean = Counter(w for c in held.values() for w in c), max(1.0, sum(sum(c.values()) for c in held.values()) / len(DOCS))
    want = set()
    for q, a in ASKED:
        scores = {d: sum(log(1 + (len(DOCS) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in words(a) if c[w]) for d, c in held.items()}
        best = sorted((d for d, s in scores.items() if s > 0), key=lambda d: (-round(scores[d], 9), d))[:k]  # noqa: B023
        want |= {(q, d, n + 1, round(scores[d], 6)) for n, d in enumerate(best)}
    assert {(r["item_id"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in R.bm25(*tables, k=k).collect()} == want


def test_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c c"), (None, "a"), (2, "z")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert {(r["doc_id"], r["n_terms"], r["tf"]) for r in R.term_matches(docs, asked).collect()} == {(1, 2, 4), (None, 1, 1)}
    for f in (R.bm25, R.term_matches, R.shared_terms):
        assert f(docs, asked.limit(0)).count() == 0 == f(docs.limit(0), asked).count()


def test_pairs_are_not_shuffled(spark):
    """Postings are dealt by document once; pairs of questions and documents pass no shuffle, and texts are read once."""
    df = catalog.QUERIES["jn8_inverted_index"](spark, "/root/testdata/sf0.001")
    assert not re.search(r"Exchange hashpartitioning\(item_id[^,]*, doc_id", df._jdf.queryExecution().executedPlan().toString())
    df = catalog.QUERIES["agg14_rrf"](spark, "/root/testdata/sf0.001")
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("documents.parquet") == 1
