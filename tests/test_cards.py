"""The card gate by hand: one card for each reason, the quota, and odd tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import cards as K

SOURCE = "堆内存用于保存对象实例，垃圾回收器负责回收不再使用的对象。线程栈用于保存局部变量。"
GOOD = ("堆内存的作用是什么？", "从对象实例的保存位置回忆", "堆内存用于保存对象实例。", ["e1"], ["u1"])
CARDS = "material string, card int, question string, hint string, answer string, evidence_ids array<string>, unit_ids array<string>, snippet string, reason string"


def gate(spark, cards, units=(("m", "u1", ["e1"]), ("m", "u2", ["e2"])), relaxed=False, evidence=(("m", "e1", SOURCE), ("m", "e2", "线程栈用于保存局部变量。"), ("m", "e2", "线程栈用于保存局部变量。"))):
    c = spark.createDataFrame([("m", k, *x, "clash", "clash") for k, x in enumerate(cards)], CARDS)
    e = spark.createDataFrame([*evidence, ("other", "e9", SOURCE)], "material string, evidence_id string, snippet string")
    u = spark.createDataFrame(list(units), "material string, unit_id string, evidence_ids array<string>")
    return {r.card: (r.reason, r.published) for r in K.gate(c, e, u, relaxed).collect()}


def but(**changes):
    return tuple(changes.get(n, v) for n, v in zip(("question", "hint", "answer", "evidence_ids", "unit_ids"), GOOD, strict=True))


REASONS = [
    (but(answer=None), "no_answer"),
    (but(answer=" \n "), "no_answer"),
    (but(answer="00:01 --> 00:02 堆内存"), "no_answer"),
    (but(evidence_ids=None), "no_evidence"),
    (but(evidence_ids=["", " "]), "no_evidence"),
    (but(evidence_ids=["e1", "e7"]), "unknown_evidence"),
    (but(evidence_ids=["e9"]), "unknown_evidence"),
    (but(unit_ids=["u1", "u7"]), "unknown_unit"),
    (but(unit_ids=["u2"]), "unit_apart"),
    (but(answer="嗯，那么，好的吧"), "not_held"),
    (but(answer="数据库索引通过树结构加速查询。"), "not_held"),
    (but(answer="堆内存用于保存对象实例，此外数据库索引加速查询速度。"), "not_held"),
    (but(question="这个作用到底是什么东西？"), "question"),
    (but(question="堆内存的作用是什么？线程栈又是什么？"), "question"),
    (but(question="请说明堆内存的作用是什么"), "question"),
    (but(question="面试官问到堆内存时你如何回答？"), "question"),
    (but(question=None), "question"),
    (but(question="短？"), "question"),
    (but(hint="回忆一下本节的核心内容。"), "hint"),
    (but(hint=None), "hint"),
    (but(hint="OCR 出现时间 12 秒 的 文字"), "hint"),
]


@pytest.mark.parametrize(("card", "reason"), REASONS)
def test_each_reason(card, reason, verdicts):
    assert verdicts[REASONS.index((card, reason))] == (reason, False)


@pytest.fixture(scope="module")
def verdicts(spark):
    return gate(spark, [c for c, _ in REASONS])


def test_accepted_repeats_and_quota(spark):
    second = ("线程栈的作用是什么？", "从局部变量的位置回忆", "线程栈用于保存局部变量。", ["e2"], ["u2"])
    assert gate(spark, [GOOD, second, GOOD]) == {0: (None, True), 1: (None, True), 2: ("repeated_question", False)}
    assert gate(spark, [GOOD]) == {0: (None, False)}  # one of two units, 0.6 of them are two
    assert gate(spark, [GOOD], relaxed=True) == {0: (None, True)}  # 0.4 of them is one
    assert gate(spark, [but(unit_ids=["nothing"])], units=()) == {0: (None, True)}  # without units no quota, and none is unknown
    assert gate(spark, [but(unit_ids=None)], relaxed=True) == {0: (None, False)}


def test_claims_and_texts(spark):
    text = "# 核心机制\n- 甲用于乙，此外丙使用丁；1. 它通过戊实现己，而且庚辛\n\n\n\n末尾  \n视频画面聚合 3"
    row = spark.range(1).select(K.answer_claims(F.lit(text)).alias("c"), K.answer_text(F.lit(text)).alias("t"), K.answer_text(F.lit("甲" * 1300)).alias("long")).first()
    assert row.c == ["甲用于乙", "丙使用丁", "戊实现己", "庚辛", "末尾", "视频画面聚合3"] and row.t is not None and "视频画面" not in row.t and "\n\n\n" not in row.t
    assert row.long == "甲" * 1200 + "..."


@pytest.mark.parametrize(("text", "is_noise"), [(None, True), ("", True), ("[00:12 --> 00:15] ，。", True), ("字幕由某某组提供", True), ("中文字幕 中文字幕", True), ("欢迎大家点赞关注", True), ("我们下期再见", True), ("说到缓存 说到缓存 说到缓存", True), ("缓存穿透" * 9, True), ("00:12 缓存穿透是指查询不存在的数据", False), ("heap memory keeps objects", False)])
def test_noise(spark, text, is_noise):
    assert spark.range(1).select(K.noise(F.lit(text).cast("string"))).first()[0] is is_noise


def test_empty_tables(spark):
    assert gate(spark, [], units=(), evidence=()) == {}


def test_long_answers_and_repeated_rows(spark):
    long = but(answer=SOURCE * 3000)
    assert gate(spark, [long, long], relaxed=True) == {0: (None, True), 1: ("repeated_question", False)}
