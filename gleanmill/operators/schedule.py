"""Spaced-repetition scheduling: the published FSRS-6 memory model, replayed over each card's reviews.

The replay is a native fold over a card's own reviews in order of time, so Python takes no part; a card's history is
the unit of one row. Ratings outside 1 to 4 and null times are left out; equal times are taken in order of rating.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default parameters of the published model, version 6.
W = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
DECAY = -W[20]
FACTOR = 0.9 ** (1 / DECAY) - 1
LEAST_STABILITY = 0.001
STATE = "struct<stability:double,difficulty:double,last:timestamp,lapses:long>"


def recall(days: Column, stability: Column) -> Column:
    """The probability of recall so many whole days after a review."""
    return F.pow(1 + FACTOR * F.greatest(days, F.lit(0)) / stability, F.lit(DECAY))


def interval(stability: Column, retention: float, longest: int = 3650) -> Column:
    """Whole days until recall falls to the wanted retention."""
    days = F.bround(stability / FACTOR * (retention ** (1 / DECAY) - 1), 0)
    return F.greatest(F.lit(1), F.least(F.lit(longest), days)).cast("int")


def _first_difficulty(rating: Column) -> Column:
    return W[4] - F.exp(W[5] * (rating - 1)) + 1


def _bounded(difficulty: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), difficulty))


def _next_difficulty(difficulty: Column, rating: Column) -> Column:
    moved = difficulty + (10 - difficulty) * (-W[6] * (rating - 3)) / 9
    return _bounded(W[7] * _first_difficulty(F.lit(4)) + (1 - W[7]) * moved)


def _next_stability(stability: Column, difficulty: Column, days: Column, rating: Column) -> Column:
    r = recall(days, stability)
    same_day = F.exp(W[17] * (rating - 3 + W[18])) * F.pow(stability, F.lit(-W[19]))
    same_day = stability * F.when(rating >= 3, F.greatest(same_day, F.lit(1.0))).otherwise(same_day)
    grown = F.exp(F.lit(W[8])) * (11 - difficulty) * F.pow(stability, F.lit(-W[9])) * (F.exp((1 - r) * W[10]) - 1)
    grown = stability * (1 + grown * F.when(rating == 2, W[15]).otherwise(1.0) * F.when(rating == 4, W[16]).otherwise(1.0))
    forgotten = W[11] * F.pow(difficulty, F.lit(-W[12])) * (F.pow(stability + 1, F.lit(W[13])) - 1) * F.exp((1 - r) * W[14])
    forgotten = F.least(forgotten, stability / F.exp(F.lit(W[17] * W[18])))
    return F.greatest(F.lit(LEAST_STABILITY), F.when(days < 1, same_day).when(rating == 1, forgotten).otherwise(grown))


def replay(reviews: DataFrame, key: str, retention: float = 0.9) -> DataFrame:
    """reviews (key, reviewed_at: timestamp, rating) to a card state per key: reviews, lapses, stability, difficulty, interval, due, recall when due."""
    ok = reviews.filter(F.col("rating").between(1, 4) & F.col("reviewed_at").isNotNull())
    log = ok.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("reviewed_at").alias("at"), F.col("rating").cast("int").alias("rating")))).alias("log"))
    first = F.element_at(F.array(*[F.lit(w) for w in W[:4]]), F.col("log")[0]["rating"])
    start = F.struct(first.alias("stability"), _bounded(_first_difficulty(F.col("log")[0]["rating"])).alias("difficulty"), F.col("log")[0]["at"].alias("last"), F.when(F.col("log")[0]["rating"] == 1, 1).otherwise(0).cast("long").alias("lapses")).cast(STATE)

    def step(s: Column, x: Column) -> Column:
        days = F.floor((F.unix_seconds(x["at"]) - F.unix_seconds(s["last"])) / 86_400)
        return F.struct(
            _next_stability(s["stability"], s["difficulty"], days, x["rating"]).alias("stability"),
            _next_difficulty(s["difficulty"], x["rating"]).alias("difficulty"),
            x["at"].alias("last"),
            (s["lapses"] + F.when(x["rating"] == 1, 1).otherwise(0)).alias("lapses"),
        ).cast(STATE)

    n = F.size("log")
    state = log.select(key, n.cast("long").alias("reviews"), F.aggregate(F.slice("log", F.lit(2), n), start, step).alias("s"))
    out = state.select(key, "reviews", "s.*").withColumn("interval_days", interval(F.col("stability"), retention))
    out = out.withColumn("due", F.col("last") + F.make_dt_interval(days=F.col("interval_days")))
    return out.withColumn("recall_when_due", F.round(recall(F.col("interval_days"), F.col("stability")), 6))
