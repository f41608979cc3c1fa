"""Hand-checked cases of the block parsers, write rules, queues, scores and the scheduler."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleanmill.operators import queues as Q
from gleanmill.operators import schedule
from gleanmill.operators import scoring as S
from gleanmill.operators import writes as W
from gleanmill.sources import blocks as B

DOCS = "document_id long, text string"


def test_text_blocks(spark):
    d = spark.createDataFrame([(1, "# Title\n\nBody one.\nMore.\n\n \n\nNotes:\n\nLast"), (2, None), (3, "")], DOCS)
    got = [tuple(r) for r in B.text_blocks(d).orderBy("document_id", "block").select("document_id", "block_type", "section", "content").collect()]
    assert got == [(1, "heading", "Title", "# Title"), (1, "text", "Title", "Body one.\nMore."), (1, "heading", "Notes", "Notes:"), (1, "text", "Notes", "Last")]


def test_markdown_blocks_and_tables(spark):
    text = "intro\n# A\n- x\n- y\n\n```py\n# no heading\n\n| no | table |\n```\n| k | v |\n|---|:-:|\n| 1 | a b |\n|2||\n\n| not | a table |\nend"
    b = B.markdown_blocks(spark.createDataFrame([(7, text), (8, None), (9, "")], DOCS))
    got = [(r["block_type"], r["section"], r["n_lines"]) for r in b.orderBy("block").collect()]
    assert got == [("text", None, 1), ("heading", "A", 1), ("list", "A", 2), ("code", "A", 5), ("table", "A", 4), ("table", "A", 1), ("text", "A", 1)]
    assert [(r["row"], r["cells"]) for r in B.table_rows(b).orderBy("block", "row").collect()] == [(0, "k\tv"), (1, "1\ta b"), (2, "2\t")]


def test_cues(spark):
    text = "WEBVTT\n\n00:05.000 --> 00:07.500 align:left\nHello\nthere\n\n2\n01:00:00,000 --> 01:00:02,000\nLate\n\n[02:03] noted\n\nno cue"
    got = [tuple(r)[2:] for r in B.cues(spark.createDataFrame([(1, text), (2, None)], DOCS)).orderBy("cue").collect()]
    assert got == [(5, 7, "Hello\nthere"), (3600, 3602, "Late"), (123, None, "noted")]


def test_writes(spark):
    card = "material_id long, source_key string"
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], card)
    e = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (4, "a")], card)
    n = spark.createDataFrame([(1, "n"), (2, "n"), (4, "n")], card)
    assert sorted(map(tuple, W.replace_if_same(a, e, n).collect())) == [(1, "n", True), (2, "a", False), (3, "a", False)]
    q = card + ", question string"
    old = spark.createDataFrame([(1, "a", "What is it?")], q)
    new = spark.createDataFrame([(1, "a", "other"), (1, "b", "what IS it"), (1, "c", "New one?"), (1, "d", "new one"), (1, "x", "gone"), (2, "b", "What is it?")], q)
    got = W.add_only(old, new, spark.createDataFrame([(1, "x")], card))
    assert sorted((r["material_id"], r["source_key"], r["added"]) for r in got.collect()) == [(1, "a", False), (1, "c", True), (2, "b", True)]
    v = "k long, version string"
    kept = W.guarded(spark.createDataFrame([(1, "card-v10"), (2, "card-v2"), (3, "none")], v), spark.createDataFrame([(1, "card-v9"), (2, "card-v2"), (3, "card-v1"), (4, "card-v1")], v), "k", "version", "card")
    assert sorted(r["k"] for r in kept.collect()) == [2, 3, 4]


def test_offsets_and_fencing(spark):
    done = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 3), ("b", 1)], "p string, o long")
    assert [tuple(r) for r in Q.committed(done, "p", "o").collect()] == [("a", 1)]
    jobs = spark.createDataFrame([(1, 2, "RUNNING"), (2, 1, "DONE")], "job_id long, active_version long, status string")
    results = spark.createDataFrame([(1, 1, "late"), (1, 2, "now"), (2, 1, "over"), (3, 1, "unknown")], "job_id long, version long, what string")
    assert [r["what"] for r in Q.fenced(results, jobs).collect()] == ["now"]


def test_parse_quality(spark):
    x = spark.range(1).select(S.parse_quality(F.lit(50), F.lit(0), F.lit(0), F.lit(2), F.lit(0.8), F.lit(1)).alias("bad"), S.parse_quality(F.lit(500), F.lit(3), F.lit(0), F.lit(9), F.lit(0.1), F.lit(0)).alias("good")).first()
    assert (x["bad"]["score"], x["bad"]["screenshot_like"], x["bad"]["needs_supplement"], len(x["bad"]["messages"])) == (0.0, True, True, 5)
    assert (x["good"]["score"], x["good"]["needs_supplement"], x["good"]["messages"]) == (1.0, False, [])


def plain_replay(log, retention=0.9):
    """The same model, step by step in plain Python."""
    w = schedule.W
    decay = -w[20]
    factor = 0.9 ** (1 / decay) - 1
    d0 = lambda r: w[4] - math.exp(w[5] * (r - 1)) + 1
    clamp = lambda d: min(10.0, max(1.0, d))
    s = d = last = None
    for at, r in log:
        if s is None:
            s, d = w[r - 1], clamp(d0(r))
        else:
            days = (at - last).days
            if days < 1:
                grow = math.exp(w[17] * (r - 3 + w[18])) * s ** -w[19]
                new = s * (max(grow, 1) if r >= 3 else grow)
            else:
                p = (1 + factor * days / s) ** decay
                if r == 1:
                    new = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp((1 - p) * w[14]), s / math.exp(w[17] * w[18]))
                else:
                    new = s * (1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp((1 - p) * w[10]) - 1) * (w[15] if r == 2 else 1) * (w[16] if r == 4 else 1))
            moved = d + (10 - d) * (-w[6] * (r - 3)) / 9
            s, d = max(0.001, new), clamp(w[7] * d0(4) + (1 - w[7]) * moved)
        last = at
    return s, d, min(3650, max(1, round(s / factor * (retention ** (1 / decay) - 1))))


def test_replay_equals_the_plain_model(spark):
    start = datetime(2024, 1, 1, 8)
    logs = {
        1: [(start, 3)],
        2: [(start, 1), (start + timedelta(hours=3), 3), (start + timedelta(days=2), 4), (start + timedelta(days=30), 1), (start + timedelta(days=31), 2)],
        3: [(start + timedelta(days=7 * k), 1 + (k * 7 + 2) % 4) for k in range(12)],
        4: [(start, 4), (start + timedelta(days=300), 4), (start + timedelta(days=3000), 4), (start + timedelta(days=9000), 4)],
    }
    rows = [(k, at, r) for k, log in logs.items() for at, r in reversed(log)] + [(5, start, 9), (6, None, 3)]
    got = {r["card"]: r for r in schedule.replay(spark.createDataFrame(rows, "card long, reviewed_at timestamp, rating int"), "card").collect()}
    assert set(got) == set(logs)
    for k, log in logs.items():
        s, d, days = plain_replay(log)
        r = got[k]
        assert abs(r["stability"] - s) < 1e-9 * max(1, s) and abs(r["difficulty"] - d) < 1e-9
        assert (r["interval_days"], r["reviews"], r["lapses"]) == (days, len(log), sum(x == 1 for _, x in log))


def test_four_ratings_order_the_memory(spark):
    at = datetime(2024, 1, 1)
    rows = [(r, at, 3) for r in range(1, 5)] + [(r, at + timedelta(days=3), r) for r in range(1, 5)]
    got = schedule.replay(spark.createDataFrame(rows, "card long, reviewed_at timestamp, rating int"), "card").orderBy("card").collect()
    s = [r["stability"] for r in got]
    assert s == sorted(s) and len(set(s)) == 4
