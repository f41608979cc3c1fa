"""Cleaning, questions, frames and near candidates by hand."""

from __future__ import annotations

import math
import random
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F

from gleanmill.operators import material as M
from gleanmill.plans.material import _frames


def each(spark, f, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    return [r["x"] for r in rows.select(f(F.col("t")).alias("x")).collect()]


def test_cleaned(spark):
    cases = {None: "", "OCR 出现时间：00:01\nreal text": "real text", "[00:01:02 --> 00:01:05] fact": "fact", "字幕由某某制作 真正内容": "真正内容", "中文字幕提供": "", "父段摘要：a b": "a b", "x 视频画面 01:02 - 01:03 y": "x y", "，。text": "text", "高级软件人才培训专家 内容": ""}
    assert each(spark, M.cleaned, cases) == list(cases.values())


def test_asks(spark):
    cases = {"什么是 Raft": True, "本节介绍为什么选举": False, "正文": False, "ok?": True, "如何" + "x" * 120: False}
    assert each(spark, M.asks, cases) == list(cases.values())


def test_source_questions(spark):
    rows = [(1, 0, None, "", "全文", "为什么要过半？它有什么作用呢。大家明白了吗？为什么要过半？"), (2, 1, "summary", "", "全文", "为什么要选举？"), (3, 2, None, "frame_ocr", "全文", "为什么要选举？"), (4, 3, None, "", "Raft 是什么？", "正文。")]
    got = M.source_questions(spark.createDataFrame(rows, "evidence_id long, position int, kind string, channel string, section string, text string")).orderBy("evidence_id", "k").collect()
    assert [(r["evidence_id"], r["question"]) for r in got] == [(1, "为什么要过半？"), (1, "它有什么作用呢"), (4, "Raft 是什么？")]


@pytest.mark.parametrize(("n", "want"), [(8, 0), (9, 9)])
def test_structured_questions(spark, n, want):
    rows = [(1, k, f"为什么 {'abcdefghijkl'[k]} 节点需要选举？") for k in range(n)] + [(1, 50, "就是为什么 a 节点需要选举呢？"), (1, 51, "为什么这个节点需要选举？")]
    assert M.structured_questions(spark.createDataFrame(rows, "m int, place int, question string"), "m").count() == want


def test_decoded(spark):
    rows = [(0, "naïve é".encode()), (1, "选举".encode("gb18030")), (2, b"\xef\xbb\xbfmark"), (3, b"\xff"), (4, None)]
    got = [r["x"] for r in spark.createDataFrame(rows, "k int, b binary").orderBy("k").select(M.decoded(F.col("b")).alias("x")).collect()]
    assert got == ["naïve é", "选举", "mark", "ÿ", None]


def test_frame_budget(spark):
    rows = [(1, k, 10 * k, f"g{k % 3}" if k % 2 else None, "initial_slide" if k == 4 else "interval", 0) for k in range(30)]
    df = spark.createDataFrame(rows, "video_id long, frame long, second long, group_id string, trigger string, priority int")
    got = [r["frame"] for r in M.frame_budget(df, 6, 15).orderBy("second").collect()]
    assert len(got) == 6 and 4 in got and all(b - a >= 2 for a, b in zip(got, got[1:], strict=False)) and got[-1] >= 25
    groups = [rows[k][3] for k in got if rows[k][3]]
    assert len(groups) == len(set(groups))


def test_near_candidates(spark):
    rows = [(1, 0, 5, "the leader of a cluster"), (1, 3, 8, "leader of a cluster"), (1, 9, 12, "other words here"), (1, 13, 15, "the leader of a clusteR!"), (2, 0, 5, "leader of a cluster"), (2, 6, 7, "")]
    got = M.without_near_candidates(spark.createDataFrame(rows, "document_id long, start long, end long, text string")).collect()
    assert sorted((r["document_id"], r["start"]) for r in got) == [(1, 0), (1, 9), (2, 0), (2, 6)]


def plain_budget(rows, budget, min_interval, per_group):
    """By the stated rule: each time all frames of a bucket that nothing taken blocks, the best of them."""
    rows = sorted(rows, key=lambda r: (r["second"], r["frame"]))
    width = max(1, math.ceil((rows[-1]["second"] - rows[0]["second"] + 1) / budget))
    quota = lambda r: r["group_id"] if r["trigger"] not in M.FREE_OF_QUOTA else None
    rank = lambda r: (abs(r["second"] - (r["second"] // width + 0.5) * width), -r["priority"], r["second"], r["frame"])
    taken = [r for r in rows if r["trigger"] == "initial_slide"][:1]
    seen = {b: [] for b in sorted({r["second"] // width for r in rows if r not in taken})}
    waiting = {b: sorted((r for r in rows if r not in taken and r["second"] // width == b), key=rank) for b in seen}

    def fits(r):
        apart = r["trigger"] == "initial_slide" or all(abs(r["second"] - t["second"]) >= min_interval for t in taken)
        return apart and (not quota(r) or sum(quota(t) == quota(r) for t in taken) < per_group)

    while (left := budget - len(taken)) > 0:
        some, n = [b for b in waiting if waiting[b]], len(taken)
        if len(some) > left:
            some = [some[len(some) // 2]] if left == 1 else [some[k] for k in sorted({round(i * (len(some) - 1) / (left - 1)) for i in range(left)})]
        for b in some:
            good = [r for r in waiting[b] if fits(r)]
            taken += good[:1]
            waiting[b] = waiting[b][waiting[b].index(good[0]) + 1 :] if good else []
        if len(taken) == n:
            break
    return {(r["video_id"], r["frame"]) for r in taken}


@pytest.mark.parametrize(("budget", "interval", "per_group"), [(12, 600, 1), (5, 40, 2), (1, 2, 1), (60, 5000, 3)])
def test_frame_budget_of_the_whole_table(spark, budget, interval, per_group):
    frames = _frames(spark, SF)
    by_video = {}
    for r in frames.collect():
        by_video.setdefault(r["video_id"], []).append(r)
    want = set().union(*[plain_budget(rows, budget, interval, per_group) for rows in by_video.values()])
    got = M.frame_budget(frames, budget, interval, per_group).collect()
    assert len(got) == len(want) and {(r["video_id"], r["frame"]) for r in got} == want


def test_near_candidates_against_all_pairs(spark):
    r, rows = random.Random(5), []
    for doc in range(6):
        base = ["".join(r.choice("abcde") for _ in range(r.choice((1, 2, 6, 12, 60)))) for _ in range(12)]
        for k in range(40):
            t = r.choice(base)
            cut, at = r.randrange(3), r.randrange(len(t))
            rows.append((doc, k // 2, k % 3, r.choice((t, t[cut:], t[:at] + "x" + t[at + 1 :], t + " " + r.choice(base), t.upper(), "", None))))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "document_id long, start long, end long, text string")
    key = lambda t: "".join(ch for ch in (t or "").lower() if ch.isalnum())
    want, kept = [], {}
    for d, s, e, k in sorted((d, s, e, key(t)) for d, s, e, t in rows):
        pairs = {k[i : i + 2] for i in range(len(k) - 1)}
        near = lambda o: (min(len(o[0]), len(k)) >= 10 and (o[0] in k or k in o[0])) or (o[1] and pairs and len(o[1] & pairs) >= 0.88 * len(o[1] | pairs))  # noqa: B023, E731
        if not any(near(o) for o in kept.setdefault(d, [])):
            kept[d].append((k, pairs))
            want.append((d, s, e))
    assert sorted(tuple(x) for x in M.without_near_candidates(df).collect()) == sorted(want) and len(want) < len(rows) * 0.8
    assert M.without_near_candidates(df.filter("false")).count() == 0


def test_near_candidates_of_one_long_document(spark):
    """10^5 candidates of one document, most of them different: no pair of them all is made."""
    text = F.concat(F.sha2((F.col("id") % 60_000).cast("string"), 256), F.when(F.col("id") >= 90_000, "q").otherwise(""))
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("document_id"), F.col("id").alias("start"), F.col("id").alias("end"), text.alias("text"))
    assert M.without_near_candidates(df).agg(F.min("start"), F.max("start"), F.count("*")).first() == (0, 59_999, 60_000)


@pytest.mark.parametrize("few", [0, 1000])
def test_near_candidates_by_marks_and_by_pairs(spark, few):
    """Texts of all classes of length, many of them of one start and end, whose letters give the order."""
    r, rows = random.Random(9), []
    for doc in range(4):
        base = ["".join(r.choice("abcdefgh选举𝒜é") for _ in range(r.choice((2, 5, 9, 10, 19, 20, 41, 90, 333, 1500)))) for _ in range(10)]
        for k in range(60):
            t = r.choice(base)
            cut, at = r.randrange(4), r.randrange(len(t))
            rows.append((doc, k // 12, 7, r.choice((t, t[cut:], t[: -cut or None], t[:at] + "x" + t[at + 1 :], t + " " + r.choice(base), r.choice(base) + t + r.choice(base)))))
    key = lambda t: "".join(ch for ch in t.lower() if ch.isalnum())
    want, kept = [], {}
    for d, s, e, k in sorted((d, s, e, key(t)) for d, s, e, t in rows):
        pairs = {k[i : i + 2] for i in range(len(k) - 1)}
        near = lambda o: (min(len(o[0]), len(k)) >= 10 and (o[0] in k or k in o[0])) or (o[1] and pairs and len(o[1] & pairs) >= 0.88 * len(o[1] | pairs))  # noqa: B023, E731
        if not any(near(o) for o in kept.setdefault(d, [])):
            kept[d].append((k, pairs))
            want.append((d, s, e))
    df = spark.createDataFrame(rows, "document_id long, start long, end long, text string")
    assert sorted(tuple(x) for x in M.without_near_candidates(df, few).collect()) == sorted(want) and len(want) < len(rows) * 0.8


@pytest.mark.parametrize("few", [0, 1000])
def test_near_candidates_of_long_texts(spark, few):
    """Work grows with the letters of a text, not with their square."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3_999)), lambda i: F.sha2((F.col("id") * 10_000 + i).cast("string"), 256)), "")
    whole = spark.range(4).select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("start"), text.alias("text")).localCheckpoint()
    part = whole.withColumn("start", F.col("start") + 1).withColumn("text", F.expr("substring(text, 2)"))
    turned = whole.withColumn("start", F.col("start") + 2).withColumn("text", F.reverse("text"))
    df = whole.unionByName(part).unionByName(turned).withColumn("end", F.col("start"))
    began = time.perf_counter()
    got = M.without_near_candidates(df, few).collect()
    assert sorted((x["document_id"], x["start"]) for x in got) == [(k, 0) for k in range(4)] and time.perf_counter() - began < 60
