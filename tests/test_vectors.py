"""Exact vector search: against brute force, with ties, several batches and small tiles, and in bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gleanmill.operators import retrieval as R


@pytest.mark.parametrize(("cells", "most"), [(1 << 21, 20_000), (64, 7)])
def test_vector_topk(spark, monkeypatch, cells, most):
    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(R, "MOST_QUERIES", most)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(400, 4)), 1)
    v[50:120], v[7] = v[3], 0.0  # copies, and a vector without a direction
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in R.vector_topk(df, df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    w = v.astype(np.float32).astype(float)
    w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    want = {}
    for q in range(0, 400, 20):
        s = w @ w[q]
        best = [int(x) for x in np.lexsort((np.arange(400), -np.round(s, 9))) if s[x] > 0][:10]
        want |= {(q, n + 1): (x, round(float(s[x]), 6)) for n, x in enumerate(best)}
    assert got == want


def test_scores_are_compared_in_tiles(spark, monkeypatch):
    """No array of all queries times all vectors of a batch is made."""
    n = 6000
    data = np.random.default_rng(1).normal(size=(n, 4)).astype(np.float32)
    df = spark.createDataFrame([(k, data[k].tolist()) for k in range(n)], "vec_id long, embedding array<float>")
    runs = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    monkeypatch.setattr(type(df), "filter", lambda self, cond: self)
    R._block_topk(df, df.withColumnRenamed("vec_id", "query_id"), 3)
    monkeypatch.undo()
    monkeypatch.setattr(R, "CELLS", 1 << 16)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(data.tolist(), pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    tracemalloc.start()
    found = sum(b.num_rows for b in runs[0]([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 3 * n and peak < n * n * 8 / 4
