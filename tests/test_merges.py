"""Merge plans by hand: one case for each fault, whole candidates, untouched cards and odd tables."""

from __future__ import annotations

import pytest

from gleanmill.operators import merges as M

CARDS = "candidate string, card int, question string, hint string, answer string, unit_ids array<string>, evidence_ids array<string>, question_keys array<string>, merged string, group int"
PLAN = f"candidate string, group int, card_indexes array<int>, topic string, reason string, target string, hint_topics array<string>, unit_ids array<string>, evidence_ids array<string>, claims array<string>, merged {M.MERGED}, card int"

ONE = (1, "堆是什么？", "h1", "- 堆保存对象。1. 栈保存变量；", ["u1", " u2 "], ["e1"], ["K 1"])
TWO = (2, "栈是什么？", "h2", "栈 保存变量！方法区保存类", ["u2", ""], ["e2", None], ["k2"])
THREE = (3, "别的？", None, None, None, None, None)
FOUR = (4, "还有？", "h4", "第四张。", ["u4"], ["e4"], ["k4"])
GOOD = dict(
    card_indexes=[1, 2], topic="t", reason="r", target="堆和栈是什么？", hint_topics=["x"], unit_ids=["u2", "u1"], evidence_ids=["e2", "e1"], claims=["堆保存对象", "栈保存变量", "方法区保存类"],
    merged=("堆和栈，是什么", "想想", "堆保存对象，栈保存变量，方法区保存类。", ["u1", "u2"], ["e1", "e2"], ["k1", "K2", "more"]),
)
FIELDS = ["card_indexes", "topic", "reason", "target", "hint_topics", "unit_ids", "evidence_ids", "claims", "merged"]
MERGED = ["question", "hint", "answer", "unit_ids", "evidence_ids", "question_keys"]


def but(**changes):
    return {**GOOD, **changes}


def new(**changes):
    return but(merged=tuple(changes.get(n, v) for n, v in zip(MERGED, GOOD["merged"], strict=True)))


def tables(spark, plans, cards=(ONE, TWO, THREE, FOUR)):
    """plans: {candidate: groups}; every candidate has the same cards."""
    c = [(k, *x, "clash", 9) for k in [*plans, "none"] for x in cards]
    p = [(k, g, *[x[n] for n in FIELDS], 7) for k, groups in plans.items() for g, x in enumerate(groups, 1)]
    return spark.createDataFrame(c, CARDS), spark.createDataFrame(p, PLAN)


OTHER = but(card_indexes=[3, 4], target="q", unit_ids=["u4"], evidence_ids=["e4"], claims=["第四张"], merged=("Q", "h", "第四张", ["u4"], ["e4"], ["k4"]))
FAULTS = [
    ([but()], None, None),
    ([but(), OTHER], None, None),
    ([new(answer="X 堆，保存对象；栈保存变量；方法区保存类")], None, None),
    ([but(card_indexes=[1])], "numbers", 1),
    ([but(card_indexes=[1, 1])], "numbers", 1),
    ([but(card_indexes=[2, 1])], "numbers", 1),
    ([but(card_indexes=[1, 5])], "numbers", 1),
    ([but(card_indexes=[0, 1])], "numbers", 1),
    ([but(card_indexes=[1, None])], "numbers", 1),
    ([but(card_indexes=None)], "numbers", 1),
    ([but(card_indexes=[])], "numbers", 1),
    ([but(), but()], "overlap", 2),
    ([but(topic=" ")], "field_missing", 1),
    ([but(target=None)], "field_missing", 1),
    ([but(hint_topics=[" ", None])], "field_missing", 1),
    ([but(claims=None)], "field_missing", 1),
    ([but(unit_ids=["u1"])], "units", 1),
    ([but(unit_ids=["u1", "u2", "u3"])], "units", 1),
    ([but(evidence_ids=None)], "evidence", 1),
    ([but(claims=["堆保存对象", "栈保存变量"])], "claims", 1),
    ([but(merged=None)], "no_merged_card", 1),
    ([new(question="别的问题")], "other_question", 1),
    ([new(unit_ids=["u1"])], "units_changed", 1),
    ([new(evidence_ids=["e1", "e2", "e3"])], "evidence_changed", 1),
    ([new(question_keys=["k1"])], "question_lost", 1),
    ([new(answer="堆保存对象，栈保存变量。")], "claim_lost", 1),
    ([new(answer=None)], "claim_lost", 1),
    ([new(hint=" \n")], "no_hint", 1),
    ([new(hint=None), but(card_indexes=[3, 4])], "units", 2),  # faults of plans come first
    ([new(hint=None), {**OTHER, "merged": None}], "no_merged_card", 2),
]


@pytest.fixture(scope="module")
def judged(spark):
    c, p = tables(spark, {str(k): groups for k, (groups, _, _) in enumerate(FAULTS)})
    return {r.candidate: r for r in M.verdicts(c, p).collect()}


def test_faults(judged):
    got = [(judged[str(k)].fault, judged[str(k)].fault_group, judged[str(k)].accepted) for k in range(len(FAULTS))]
    assert got == [(fault, group, fault is None) for _, fault, group in FAULTS]


def test_cards_after(spark):
    c, p = tables(spark, {"good": [but(), OTHER], "half": [but()], "bad": [but(), but()]})
    out = {(r.candidate, r.card): r for r in M.applied(c, p).collect()}
    assert sorted(k for k in out if k[0] in ("good", "half")) == [("good", 1), ("good", 3), ("half", 1), ("half", 3), ("half", 4)]
    assert out["good", 1].question == "堆和栈，是什么" and out["good", 1].merged and out["good", 3].answer == "第四张"
    old = {(r.candidate, r.card): tuple(r)[2:8] for r in c.collect()}
    for k, r in out.items():
        assert r.merged == (k in {("good", 1), ("good", 3), ("half", 1)})
        assert r.merged or tuple(r)[2:8] == old[k]
    assert len(out) == 2 + 3 + 4 + 4


def test_odd_tables(spark):
    c, p = tables(spark, {"a": [but()]})
    assert M.verdicts(c, p.limit(0)).count() == 0 and M.applied(c, p.limit(0)).count() == 8
    assert [(r.fault, r.accepted) for r in M.verdicts(c.limit(0), p).collect()] == [("numbers", False)]
    assert M.applied(c.limit(0), p).count() == M.fingerprints(c.limit(0)).count() == 0
    long = "长" * 200_000 + "。" + "短句"
    c, p = tables(spark, {"a": [but(claims=["长" * 1200, "短句", "方法区保存类", "栈保存变量"], merged=("堆和栈是什么", "h", long + "方法区保存类，栈保存变量", ["u1", "u2"], ["e1", "e2"], ["k1", "k2"]))]}, [(*ONE[:3], long, *ONE[4:]), TWO])
    assert M.verdicts(c, p).first().accepted


def test_fingerprint_ignores_order_and_division(spark):
    a = [("x", 1, "Q?", None, None, ["u1", "u2"], ["e1"], None, None, 1), ("x", 2, "r", None, None, ["u3"], ["e1"], None, None, 1)]
    b = [("y", 1, "R", None, None, ["u3", " u2", "u1"], None, None, None, 1), ("y", 2, "q", None, None, [None, ""], ["e1"], None, None, 1)]
    n = [("z", 1, "q", None, None, ["u1", "u2"], ["e1"], None, None, 1)]
    f = {r.candidate: (r.n_items, r.item_sum) for r in M.fingerprints(spark.createDataFrame(a + b + n, CARDS)).collect()}
    assert f["x"] == f["y"] != f["z"] and f["x"][0] == 6
