"""Offline evaluation: gates, decisions between two arms, exact percentiles, and edit similarity of texts."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedupe_key

#: What speaks against an arm, in order.
REASONS = (
    "至少一个实验臂未完成", "人工金标知识点召回率绝对提升不足 10 个百分点", "LangExtract 原始结果的 evidence 映射成功率低于 95%", "过滤后的无支撑率高于当前方案",
    "LangExtract 重复率高于当前方案", "LangExtract Token 成本超过当前方案的 1.5 倍", "未同时覆盖结构化问题资料和陈述式课程资料",
)
CATEGORIES = ("structured_questions", "declarative_course")
#: The shortest block that is found by diagonals, and the letter pairs compared at once.
RUN, CELLS = 3, 1 << 23


def gate(cases: DataFrame, metrics: tuple[str, ...] = ("reciprocal_rank", "recall_at_5")) -> DataFrame:
    """One row: counts of main and boundary cases, averages over main cases that have a value, and whether all gates hold.

    cases: (case_type, top1_hit, top3_hit, evidence_reference_ok, evidence_count, boundary_passed, answer_point_coverage, metrics ...).
    """
    main, edge = F.col("case_type") == "ragas", F.col("case_type") == "manual_boundary"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = cases.agg(
        n(main).alias("main_case_count"), n(edge).alias("boundary_case_count"), n(main & F.col("top1_hit")).alias("top1_hit_count"), n(main & F.col("top3_hit")).alias("top3_hit_count"), n(main & F.col("evidence_reference_ok")).alias("evidence_reference_ok_count"),
        n(main & (F.col("evidence_count") == 0)).alias("empty_evidence_main_count"), n(edge & F.col("boundary_passed")).alias("boundary_passed_count"), *[F.bround(F.avg(F.when(main, F.col(m))), 6).alias(m) for m in metrics],
        F.bround(F.coalesce(F.sum(F.when(main, F.col("answer_point_coverage"))), F.lit(0.0)) / F.greatest(n(main), F.lit(1)), 4).alias("average_answer_point_coverage"),
    )
    passed = (F.col("top3_hit_count") >= F.ceil(F.col("main_case_count") * 0.9)) & (F.col("evidence_reference_ok_count") == F.col("main_case_count")) & (F.col("boundary_passed_count") == F.col("boundary_case_count")) & (F.col("empty_evidence_main_count") <= 2)
    return out.withColumn("offline_passed", passed)


def decision(cases: DataFrame) -> DataFrame:
    """One row: whether the new arm may be used, recalls, tokens, and the reasons against it.

    cases: (category, a and b: struct of status, recall, mapped, ungrounded, duplicates, tokens), a the present arm.
    """
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    x = cases.agg(
        F.count("*").alias("n"), F.avg("a.recall").alias("recall_a"), F.avg("b.recall").alias("recall_b"), F.coalesce(F.sum("a.tokens"), F.lit(0)).alias("tokens_a"), F.coalesce(F.sum("b.tokens"), F.lit(0)).alias("tokens_b"),
        some((F.col("a.status") != "COMPLETED") | (F.col("b.status") != "COMPLETED")).alias("open"), some(F.col("b.mapped") < 0.95).alias("unmapped"), some(F.col("b.ungrounded") > F.col("a.ungrounded")).alias("ungrounded"),
        some(F.col("b.duplicates") > F.col("a.duplicates")).alias("duplicates"), F.size(F.array_intersect(F.collect_set("category"), F.array(*map(F.lit, CATEGORIES)))).alias("covered"),
    )
    costly = (F.col("tokens_a") == 0) | (F.col("tokens_b") > 1.5 * F.col("tokens_a"))
    against = [F.col("open"), F.bround(F.col("recall_b") - F.col("recall_a"), 9) < 0.10, F.col("unmapped"), F.col("ungrounded"), F.col("duplicates"), costly, F.col("covered") < len(CATEGORIES)]
    reasons = F.when(F.col("n") == 0, F.array(F.lit("没有完成任何 A/B 用例"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in zip(against, REASONS, strict=True)])))
    out = x.withColumn("reasons", reasons)
    return out.select((F.size("reasons") == 0).alias("enable"), F.bround("recall_a", 6).alias("recall_a"), F.bround("recall_b", 6).alias("recall_b"), "tokens_a", "tokens_b", "reasons")


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles (linear between ranks) of each key, named by `shares`.

    Approximate ones bound where each must lie; values below are only counted, and the few distinct values between
    the bounds are ranked by their counts, so no key is sorted in one task. Keys of few rows need no bounds.
    """
    slack, precise, few = 0.002, 10_000, 5_000  # the sketch errs by one in `precise` ranks, far less than the slack
    known = rows.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    near = lambda s: F.approx_percentile("_v", F.lit(float(min(1.0, max(0.0, s)))), F.lit(precise))
    bounds = known.groupBy(key).agg(F.count("*").alias("_n"), *[f for name, s in shares.items() for f in (near(s - slack).alias(f"_lo_{name}"), near(s + slack).alias(f"_hi_{name}"))])
    met = known.join(bounds, key)
    parts = []
    for name, s in shares.items():
        many = F.col("_n") >= few
        lo, hi = F.when(many, F.col(f"_lo_{name}")).otherwise(float("-inf")), F.when(many, F.col(f"_hi_{name}")).otherwise(float("inf"))
        counted = met.filter(F.col("_v") <= hi).groupBy(key, F.when(F.col("_v") >= lo, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
        upto = F.sum("_c").over(Window.partitionBy(key).orderBy(F.asc_nulls_first("_v")))
        at = (F.col("_n") - 1) * F.lit(float(s))
        ranked = counted.withColumn("_to", upto).withColumn("_at", at)
        pick = lambda place: F.min(F.when(F.col("_v").isNotNull() & (F.col("_to") > place), F.col("_v")))
        both = ranked.groupBy(key).agg(F.first("_at").alias("_at"), pick(F.floor("_at")).alias("_a"), pick(F.ceil("_at")).alias("_b"))
        parts.append(both.select(key, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias(name)))
    return reduce(lambda a, b: a.join(b, key), parts)


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of RUN or more equal letters on the diagonals of a against b: their starts in a, in b, and their lengths."""
    n, m = len(a), len(b)
    a = np.append(a, a.dtype.type(1))  # letters are 2 and more: 0 and 1 equal nothing and end every diagonal
    padded = np.concatenate([np.zeros(n, b.dtype), b, np.zeros(n + 1, b.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, n + 1)[1 : n + m]
    step, found = max(1, CELLS // (n + 1)), []
    for low in range(0, len(windows), step):  # a bounded number of cells at a time
        same = (windows[low : low + step] == a).ravel()
        long = np.zeros(-(-len(same) // 8) * 8, bool)  # whole words, of which few have a run
        inner = long[: max(0, len(same) - RUN + 1)]
        inner[:] = same[: len(inner)]
        for k in range(1, RUN):
            inner &= same[k : len(inner) + k]
        word = np.flatnonzero(long.view(np.uint64))
        at = (word[:, None] * 8 + np.arange(8))[long.reshape(-1, 8)[word]]
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        begin, size = at[first], np.diff(first, append=len(at)) + RUN - 1
        found.append((begin // (n + 1) + low, begin % (n + 1), size))
    row, i, size = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, i + row - (n - 1), size


def _alike(a: str, b: str, least: float) -> bool:
    """Whether SequenceMatcher(None, a, b, autojunk=False).ratio() >= least, by the same blocks.

    The longest block splits both texts into what is before and after it. Runs of equal letters are found once and clipped
    to the parts; parts whose longest block is shorter than RUN are matched by difflib. The larger parts go first, and it ends
    as soon as what is matched is enough, or all that is left to match is not.
    """
    total = len(a) + len(b)
    enough = lambda matched: not total or 2.0 * matched / total >= least
    if a == b:
        return enough(len(a))
    shared = sum((Counter(a) & Counter(b)).values())
    if not shared or not enough(shared):
        return enough(0)
    codes = np.unique(np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1] + 2
    codes = codes.astype(np.uint8 if codes.max() < 256 else np.uint32)
    matched, left = 0, min(len(a), len(b))
    parts = [(-left, 0, len(a), 0, len(b), *_runs(codes[: len(a)], codes[len(a) :]))]
    while parts:
        most, alo, ahi, blo, bhi, i, j, size = heappop(parts)
        left += most
        cut = np.maximum(np.maximum(alo - i, blo - j), 0)
        i, j, size = i + cut, j + cut, size - cut
        size = np.minimum(size, np.minimum(ahi - i, bhi - j))
        keep = size >= RUN
        i, j, size = i[keep], j[keep], size[keep]
        if not len(size):
            matched += sum(x.size for x in SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks())
        else:
            k = int(size.max())
            longest = np.flatnonzero(size == k)
            x = longest[np.lexsort((j[longest], i[longest]))[0]]
            x, y = int(i[x]), int(j[x])
            matched += k
            for lo, hi, low, high, own in ((alo, x, blo, y, (i < x) & (j < y)), (x + k, ahi, y + k, bhi, (i + size > x + k) & (j + size > y + k))):
                if lo < hi and low < high:
                    heappush(parts, (-min(hi - lo, high - low), lo, hi, low, high, i[own], j[own], size[own]))
                    left += min(hi - lo, high - low)
        if enough(matched):
            return True
        if not enough(matched + left):
            return False
    return enough(matched)


def similar(left: Column, right: Column, least: float) -> Column:
    """Whether the Ratcliff-Obershelp ratio of two texts, which Spark has no function for, is `least` or more; null with null.

    Python functions run for every row, also within a condition: rows that need no ratio should pass null.
    """

    def judged(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if not isinstance(x, str) or not isinstance(y, str) else _alike(x, y, least) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(judged, "boolean")(left, right)


def _shorter(a: Column, b: Column) -> tuple[Column, Column]:
    return F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)


def same_question(left: Column, right: Column) -> Column:
    """Equal keys, one within the other and nearly as long, or a ratio of 0.86; keys without letters are none."""
    a, b = dedupe_key(F.coalesce(left, F.lit(""))), dedupe_key(F.coalesce(right, F.lit("")))
    short, long = _shorter(a, b)
    held = (F.length(short) >= 10) & F.contains(long, short) & (F.length(short) / F.length(long) >= 0.72)
    known = F.when((a == "") | (b == ""), False).when((a == b) | held, True)
    return F.coalesce(known, similar(F.when(known.isNull(), a), b, 0.86))


def near_texts(left: Column, right: Column) -> Column:
    """Equal keys, one within the other at 0.58 of its length, or (from 10 characters) a ratio of 0.82."""
    short, long = _shorter(left, right)
    held = (F.length(short) >= 8) & F.contains(long, short) & (F.length(short) / F.length(long) >= 0.58)
    known = F.when((left == right) | held, True).when(F.length(short) < 10, False)
    return F.coalesce(known, similar(F.when(known.isNull(), left), right, 0.82))


def safe_correction(before: Column, after: Column) -> Column:
    """A correction of a recognised text is taken if its length stays within 0.55 to 1.45 and the ratio is 0.55 or more."""
    ratio = F.length(after) / F.greatest(F.length(before), F.lit(1))
    known = F.when((F.coalesce(F.trim(after), F.lit("")) == "") | ~ratio.between(0.55, 1.45), False)
    return F.coalesce(known, similar(F.when(known.isNull(), before), after, 0.55))
