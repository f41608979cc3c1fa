"""Merge plans of review cards: groups of a candidate's cards become one card each, if nothing they hold is lost.

A plan row names cards by their numbers, says what must be kept, and carries the card that shall replace them. A candidate
is accepted as a whole or not at all, by the first fault: those of plans come before missing cards, and these before
faults of merged cards; within each, groups are judged in their order. Accepted groups put their card at the first
number; all other cards of all candidates stay as they are, column by column.

Numbers are exploded and joined on (candidate, number), and folded back to one row a group, so a candidate with a third of
all cards is no larger a task than others; what is gathered is what one group's cards hold. Null and blank ids, claims and
lists count as missing, repeated ones once. Null texts are empty. Cards that share a number count as one card to the plan
and are all replaced. Empty tables give empty results; a candidate without a plan keeps its cards and has no verdict.
Extra columns are ignored. Long texts are read whole, but for the cut of each claim that the rule states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
CLAIM_ENDS = r"[。！？!?；;\n]+"
CLAIM_MARK = r"^\s*(?:[-*+>] |\d+[.)]\s*)"
CLAIM_MOST = 1200

#: The card that replaces a group.
MERGED = "struct<question: string, hint: string, answer: string, unit_ids: array<string>, evidence_ids: array<string>, question_keys: array<string>>"
CARD = ["question", "hint", "answer", "unit_ids", "evidence_ids", "question_keys"]


def key(text: Column) -> Column:
    """Letters and digits only, in lower case: texts with one key say the same."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _trim(text: Column) -> Column:
    return F.trim(text)


def _set(items: Column, each) -> Column:
    """The distinct values of a list by `each`, without empty ones."""
    values = F.transform(F.coalesce(items, F.array().cast("array<string>")), each)
    return F.array_distinct(F.filter(values, lambda x: F.length(x) > 0))


def claim_keys(answer: Column) -> Column:
    """Keys of an answer's claims: parts between strong marks, without list marks, cut to CLAIM_MOST characters."""
    return _set(F.split(_strip(answer), CLAIM_ENDS), lambda x: key(F.substring(_strip(F.regexp_replace(x, CLAIM_MARK, "")), 1, CLAIM_MOST)))


def _same(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _named(plan: DataFrame) -> DataFrame:
    """A row for each number that a group names; `again`: a group before it names the number too."""
    p = plan.select("candidate", "group", F.posexplode_outer("card_indexes").alias("pos", "card"))
    return p.withColumn("again", F.min("group").over(Window.partitionBy("candidate", "card")) < F.col("group"))


def judged(cards: DataFrame, plan: DataFrame) -> DataFrame:
    """(candidate, group, stage, fault) of each group: its first fault, or null.

    cards: candidate, card, question, hint, answer, unit_ids, evidence_ids, question_keys. plan: candidate, group,
    card_indexes, topic, reason, target, hint_topics, unit_ids, evidence_ids, claims, merged.
    """
    held = cards.select(
        "candidate", "card", F.lit(True).alias("known"), _set(F.col("unit_ids"), _trim).alias("u"), _set(F.col("evidence_ids"), _trim).alias("e"),
        _set(F.col("question_keys"), key).alias("q"), claim_keys(F.col("answer")).alias("c"),
    )
    union = lambda name: F.array_distinct(F.flatten(F.collect_list(name))).alias(name)
    strange = F.bool_or(F.col("card").isNull() | F.col("known").isNull()).alias("strange")
    whole = _named(plan).join(held, ["candidate", "card"], "left").groupBy("candidate", "group").agg(strange, F.bool_or("again").alias("again"), *map(union, "ueqc"))
    numbers, m = F.coalesce("card_indexes", F.array().cast("array<int>")), "merged."
    blank = lambda *names: [F.length(_strip(F.col(n))) == 0 for n in names]
    bare = [*blank("topic", "reason", "target"), *[F.size(_set(F.col(n), _strip)) == 0 for n in ("hint_topics", "claims")]]
    missing = bare[0]
    for b in bare[1:]:
        missing = missing | b
    planned = _set(F.col("claims"), lambda x: key(F.substring(_strip(x), 1, CLAIM_MOST)))
    ids = lambda name: _set(F.col(name), _trim)
    answer = key(F.col(m + "answer"))
    steps = [
        (1, "numbers", (F.size(numbers) < 2) | F.coalesce(F.col("strange"), F.lit(True)) | (numbers != F.array_sort(F.array_distinct(numbers)))),
        (1, "overlap", F.col("again")),
        (1, "field_missing", missing),
        (1, "units", ~_same(ids("unit_ids"), F.col("u"))),
        (1, "evidence", ~_same(ids("evidence_ids"), F.col("e"))),
        (1, "claims", ~_within(F.col("c"), planned)),
        (2, "no_merged_card", F.col("merged").isNull()),
        (3, "other_question", key(F.col(m + "question")) != key(F.col("target"))),
        (3, "units_changed", ~_same(ids(m + "unit_ids"), F.col("u"))),
        (3, "evidence_changed", ~_same(ids(m + "evidence_ids"), F.col("e"))),
        (3, "question_lost", ~_within(F.col("q"), _set(F.col(m + "question_keys"), key))),
        (3, "claim_lost", ~F.forall(planned, lambda c: F.contains(answer, c))),
        (3, "no_hint", F.length(_strip(F.col(m + "hint"))) == 0),
    ]
    first = F.coalesce(*[F.when(test, F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("fault"))) for stage, name, test in steps])
    return plan.join(whole, ["candidate", "group"], "left").select("candidate", "group", first.alias("f")).select("candidate", "group", "f.stage", "f.fault")


def verdicts(cards: DataFrame, plan: DataFrame) -> DataFrame:
    """(candidate, accepted, fault, fault_group) of each candidate with a plan."""
    fault = F.min(F.when(F.col("fault").isNotNull(), F.struct("stage", "group", "fault"))).alias("f")
    return judged(cards, plan).groupBy("candidate").agg(fault).select("candidate", F.col("f").isNull().alias("accepted"), "f.fault", F.col("f.group").alias("fault_group"))


def applied(cards: DataFrame, plan: DataFrame) -> DataFrame:
    """All cards after the merges of accepted candidates; `merged` marks the cards that replace a group."""
    good = verdicts(cards, plan).filter("accepted").select("candidate")
    touched = plan.join(good, "candidate").select("candidate", F.col("merged").alias("new"), F.posexplode("card_indexes").alias("pos", "card"))
    touched = touched.withColumn("new", F.when(F.col("pos") == 0, F.col("new")))
    put = F.col("pos").isNotNull()
    left = cards.select("candidate", "card", *CARD).join(touched, ["candidate", "card"], "left").filter("pos is null or pos = 0")
    return left.select("candidate", "card", *[F.when(put, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in CARD], put.alias("merged"))


def fingerprints(cards: DataFrame) -> DataFrame:
    """(candidate, n_items, item_sum): what a candidate holds, whatever the order and number of its cards; equal before and after a round without progress.

    Distinct question keys, unit ids and evidence ids are counted, and the first 60 bits of their MD5 summed: nothing is gathered.
    """
    kinds = F.array(
        F.struct(F.lit("question").alias("kind"), F.array(key(F.col("question"))).alias("v")),
        F.struct(F.lit("unit").alias("kind"), _set(F.col("unit_ids"), _trim).alias("v")),
        F.struct(F.lit("evidence").alias("kind"), _set(F.col("evidence_ids"), _trim).alias("v")),
    )
    items = cards.select("candidate", F.explode(kinds).alias("k")).select("candidate", "k.kind", F.explode("k.v").alias("v")).filter("v <> ''").distinct()
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "v")), 1, 15), 16, 10).cast("decimal(20,0)")
    return items.groupBy("candidate").agg(F.count("*").alias("n_items"), F.sum(bits).cast("string").alias("item_sum"))
