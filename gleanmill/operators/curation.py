"""Curation of candidate texts: noise, claims and their grounding, question rules, patch checks, compaction of conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Patterns and word lists that results depend on.
CLAIM_ENDS = r"[。！？!?；;\n]+"
NOISE_MARKS = r"[\s，。；：:,.!?！？、]+"
SPOKEN_PREFIX = (
    r"^(?:(?:就是|可能|然后|还有|嗯|啊|呃|哎|好|就比如说|我就被问过|他会问你|他会问|面试官(?:可能)?(?:会)?问你|"
    r"第[一二三四五六七八九十百千万0-9]+个(?:说|是)?)[，,、:：\s]*)+"
)
SPOKEN_FILLER = r"^(?:(?:嗯|啊|呃|哎|就是|可能|然后|还有)[，,、:：\s]*)+"
SPOKEN_TURN = r"^(?:那|那么|这时候)\s*"
FINAL_PARTICLES = r"[，,、\s]*(?:呢|啊|呀|吧)+[？?。！!]*$"
QUESTION_FORM = (
    "什么|为什么|为何|如何|怎么|怎样|哪些|哪一种|哪种|哪个|是否|能否|有何|有什么|"
    "区别|作用|含义|机制|流程|条件|场景|原因|由谁|由什么|通过什么|分别"
)
RECALL_FORM = r"^(?:请你?)?(?:解释|比较|分析|描述)\s*"
TASK_START = r"^(?:请)?(?:说明|列出|概括|总结|梳理|阐述|指出|回忆)"
POINTING_START = (
    r"^(?:那|那么|然后|所以|这时|这时候|这个|这些|那这些|它|其|这里|那里|上述|前面|刚才|"
    r"大家|同学们|我们|面试官(?:可能)?(?:会)?(?:顺着)?问)"
)
ANSWER_IN_QUESTION = r"(?:解决方案|策略|类型|组成)(?:包括|例如|比如|如[：:]?)"
NOISE_WIDTHS = range(3, 13)
NOISE_SHARE, NOISE_COUNT, NOISE_LEAST = 60, 3, 18
#: n-gram coverage and common characters that ground a claim: strict, relaxed.
GROUNDED = {False: (0.12, 6), True: (0.08, 4)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, not again for every element of a lambda that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(chars: Column, width: Column) -> Column:
    """All windows of `width` of an array of characters, in time linear in its size. Both are bound by `_let`."""
    starts = F.when(F.size(chars) >= width, F.sequence(F.lit(1), F.size(chars) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, width), ""))


def _chars(text: Column) -> Column:
    """The characters of a text; an empty one has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def repeated_ngram(text: Column) -> Column:
    """True if an n-gram of 3 to 12 characters occurs three times or more and makes up 60 % of the text without spaces and marks.

    Each width sorts its n-grams; one with m copies equals the one m - 1 places further. Null and short texts: false.
    The first three characters of such an n-gram occur as often, so texts without three characters that occur as often as
    the longest n-grams must have none, and are told by one width.
    """

    def wide(chars: Column, w: Column, share: Column | None = None) -> Column:
        least = F.greatest(F.lit(NOISE_COUNT), F.ceil(F.size(chars) * NOISE_SHARE / (100.0 * (w if share is None else share))).cast("int"))
        repeated = lambda s: F.exists(F.transform(s, lambda x, i: F.coalesce(x == F.get(s, i + least - 1), F.lit(False))), lambda x: x)
        return (F.size(chars) >= 3 * w) & _let(F.sort_array(_windows(chars, w)), repeated)

    widths = F.array(*[F.lit(w) for w in NOISE_WIDTHS])
    key = F.regexp_replace(F.coalesce(text, F.lit("")), NOISE_MARKS, "")
    return _let(_chars(key), lambda chars: (F.size(chars) >= NOISE_LEAST) & wide(chars, F.lit(min(NOISE_WIDTHS)), F.lit(max(NOISE_WIDTHS))) & F.exists(widths, lambda w: wide(chars, w)))


def claims(answer: Column) -> Column:
    """Normalised claims of an answer, split at strong punctuation; headings and empty ones are left out."""
    parts = F.filter(F.split(F.coalesce(answer, F.lit("")), CLAIM_ENDS), lambda x: ~F.ltrim(x).startswith("#"))
    return F.filter(F.transform(parts, T.dedupe_key), lambda x: F.length(x) > 0)


def grounded(claim: Column, source: Column, relaxed: bool = False) -> Column:
    """Whether a normalised claim is held by a normalised source: contained, or enough of its distinct n-grams and one
    common run of characters. A common run of k characters is a window of k that the source contains, so no longest
    common substring is computed."""
    least, run = GROUNDED[relaxed]

    def held(source: Column, chars: Column) -> Column:
        n = F.size(chars)
        grams = lambda w: F.array_distinct(_windows(chars, w))
        share = lambda g: F.coalesce(F.size(F.filter(g, lambda x: F.contains(source, x))) / F.nullif(F.size(g), F.lit(0)), F.lit(0.0))
        covered = _let(F.when(n <= 12, F.lit(3)).otherwise(F.lit(4)), lambda w: _let(grams(w), share))
        common = _let(F.least(F.lit(run), n), lambda w: F.exists(_windows(chars, w), lambda x: F.contains(source, x)))
        return (covered >= least) & common

    return F.contains(source, claim) | _let(source, lambda s: _let(_chars(claim), lambda chars: held(s, chars)))


def question_key(question: Column) -> Column:
    """The stable key of a spoken question: prefixes and final particles go, and a head that its tail repeats."""
    q = F.substring(T.collapsed(F.coalesce(question, F.lit(""))), 1, 180)
    for pattern in (SPOKEN_PREFIX, SPOKEN_FILLER, SPOKEN_TURN):
        q = F.regexp_replace(q, pattern, "")
    parts = F.filter(F.transform(F.split(q, "[，,、]"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    head, tail = F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1)
    repeated = (F.size(parts) >= 2) & (F.length(T.dedupe_key(head)) >= 4) & F.contains(T.dedupe_key(tail), T.dedupe_key(head))
    return T.dedupe_key(F.regexp_replace(F.when(repeated, tail).otherwise(q), FINAL_PARTICLES, ""))


def first_card(cards: DataFrame, order: list[str]) -> DataFrame:
    """cards (question, source_key, ...): the first of each question, or of each source key where there is no question; without both none."""
    key = F.coalesce(F.nullif(T.dedupe_key(F.col("question")), F.lit("")), F.nullif(F.col("source_key"), F.lit("")))
    w = Window.partitionBy("_k").orderBy(*order)
    return cards.withColumn("_k", F.sha2(key, 256)).filter("_k is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_k", "_n")


def question_fault(question: Column, noise: bool = True) -> Column:
    """The first rule that a review question breaks, else null; `noise`: whether repeated n-grams are a rule, which SF51's SQL leaves to SF26."""
    q = T.collapsed(F.coalesce(question, F.lit("")))
    return (
        F.when(~F.length(T.dedupe_key(q)).between(8, 180), "length")
        .when(F.regexp_count(q, F.lit("[？?]")) > 1, "several_questions")
        .when(q.rlike(ANSWER_IN_QUESTION), "answer_in_question")
        .when(repeated_ngram(q) if noise else F.lit(False), "noise")
        .when(q.rlike(POINTING_START), "pointing_start")
        .when(q.rlike(TASK_START), "task")
        .when(~(q.rlike(QUESTION_FORM) | q.rlike(RECALL_FORM)), "no_question_form")
    )


def validate_patches(patches: DataFrame, fields: DataFrame, allowed: DataFrame, version: Column) -> DataFrame:
    """patches (patch_id, field_id, text_hash, evidence_ids, risk_flags) with the sorted names of what is wrong.

    fields: (field_id, version, text_hash, unsupported, required), once each; allowed: (evidence_id). A patch_id stands
    for one patch: rows that share it share their faults. A field's first patch, by patch_id, is no duplicate. Evidence is joined by id, never collected.
    """
    f = fields.select("field_id", F.col("version").alias("_v"), F.col("text_hash").alias("_h"), "unsupported", "required", F.lit(True).alias("_known"))
    cited = patches.select("patch_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    foreign = cited.join(allowed.select("evidence_id").distinct(), "evidence_id", "left_anti").select("patch_id").distinct().withColumn("_foreign", F.lit(True))
    first = F.min("patch_id").over(Window.partitionBy("field_id"))
    known = F.col("_known").isNotNull()
    faults = {
        "duplicate": known & (F.col("patch_id") > F.col("_first")),
        "foreign_evidence": known & F.col("_foreign").isNotNull(),
        "hash": known & ~F.col("text_hash").eqNullSafe(F.col("_h")),
        "mixed_none": known & F.array_contains("risk_flags", "NONE") & (F.size("risk_flags") > 1),
        "no_evidence": known & F.col("required") & (F.size("evidence_ids") == 0),
        "unknown_field": ~known,
        "unsupported": known & F.col("unsupported"),
        "version": known & ~F.col("_v").eqNullSafe(version),
    }
    j = patches.withColumn("_first", first).join(f, "field_id", "left").join(foreign, "patch_id", "left")
    return j.select("patch_id", "field_id", F.array_compact(F.array(*[F.when(c, name) for name, c in faults.items()])).alias("faults"))


def covered_range(windows: DataFrame, summaries: DataFrame, key: str, order: str) -> DataFrame:
    """Summaries (key, start_id, end_id) with a range that lies in the window of messages (key, order), else the whole window."""
    ends = windows.groupBy(key).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    have = windows.select(key, order).distinct()
    known = lambda c: have.select(key, F.col(order).alias(c), F.lit(True).alias(f"_{c}"))
    j = summaries.join(ends, key, "left").join(known("start_id"), [key, "start_id"], "left").join(known("end_id"), [key, "end_id"], "left")
    fits = F.col("_start_id").isNotNull() & F.col("_end_id").isNotNull() & (F.col("start_id") <= F.col("end_id"))
    return j.select(key, F.when(fits, F.col("start_id")).otherwise(F.col("_low")).alias("start_id"), F.when(fits, F.col("end_id")).otherwise(F.col("_high")).alias("end_id"))


def compacted(messages: DataFrame, key: str, order: str, text: str, threshold: int, target: int, recent: int = 8, each: int = 600, most: int = 1200) -> DataFrame:
    """Per conversation above `threshold` tokens: where the kept tail begins and a summary of the last older messages.

    The tail is the newest messages within the budget, the newest always; if all fit, only the newest is the tail.
    The summary joins the last `recent` older messages, `each` characters of one, `most` in all.
    """
    budget = max(min(4000, max(1, threshold // 2)), threshold - max(target * 2, threshold // 10))
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    m = messages.select(key, order, F.substring(F.coalesce(text, F.lit("")), 1, each).alias("_t"))
    m = m.withColumn("_n", T.token_estimate(F.col("_t"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(key)))
    m = m.withColumn("_back", F.row_number().over(newest)).withColumn("_sum", F.sum(F.greatest(F.lit(1), F.col("_n"))).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.filter(F.col("_all") > threshold).withColumn("_kept", (F.col("_sum") <= budget) | (F.col("_back") == 1))
    m = m.withColumn("_older", F.count_if(~F.col("_kept")).over(Window.partitionBy(key)))
    m = m.withColumn("_kept", F.when(F.col("_older") == 0, F.col("_back") == 1).otherwise(F.col("_kept")))
    m = m.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_kept").orderBy(F.desc(order))))
    last = F.array_sort(F.collect_list(F.when(~F.col("_kept") & (F.col("_place") <= recent), F.struct(F.col(order).alias("o"), F.col("_t").alias("t")))))
    return m.groupBy(key).agg(
        F.min(F.when(F.col("_kept"), F.col(order))).alias("tail_start"),
        F.count_if(~F.col("_kept")).alias("n_older"),
        F.substring(F.array_join(F.filter(F.transform(last, lambda x: x["t"]), lambda t: F.length(t) > 0), "；"), 1, most).alias("summary"),
    )


def keyword_hits(pieces: DataFrame, terms: DataFrame, key: str, order: str, text: str, k: int = 20) -> DataFrame:
    """Per key the k pieces (a limit by purpose) with the highest keyword score and their neighbours, by place.

    terms: (key, term), normalised. A term counts at most four times, weighted with its length up to eight.
    """
    numbered = pieces.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    by_key = terms.filter(F.length("term") > 0).groupBy(key).agg(F.collect_set("term").alias("_terms"))  # the words of one question
    body = T.dedupe_key(F.col(text))
    times = lambda b, t: F.floor((F.length(b) - F.length(F.replace(b, t, F.lit("")))) / F.length(t))
    score = _let(body, lambda b: F.aggregate("_terms", F.lit(0).cast("long"), lambda a, t: a + F.least(F.lit(4), times(b, t)) * F.least(F.lit(8), F.length(t))))
    scored = numbered.join(by_key, key).withColumn("score", score).filter("score > 0")
    top = scored.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "place"))).filter(F.col("_r") <= k)
    near = top.select(key, F.explode(F.sequence(F.greatest(F.col("place") - 1, F.lit(0)), F.col("place") + 1)).alias("place")).distinct()
    return numbered.join(near, [key, "place"], "left_semi").select(key, order, "place")
