"""Scores and decisions as column expressions, and small plans around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What the parse-quality score says about a document.
SPARSE, SHORT, BARE = "native text is sparse", "native text is short", "no paragraph or table block"
SCREENSHOT, EMPTY_CELLS, EMBEDDED = "document looks like screenshot or image-heavy file", "spreadsheet has high empty cell ratio", "embedded objects may need layout parser"


def parse_quality(chars: Column, paragraphs: Column, tables: Column, media: Column, empty_ratio: Column, embedded: Column) -> Column:
    """struct(score, screenshot_like, needs_supplement, messages): penalties for each weakness that the counts show."""
    screenshot = (chars < 120) & (media >= 1)
    rules = [
        (chars < 80, 0.35, SPARSE),
        ((chars >= 80) & (chars < 300), 0.15, SHORT),
        ((paragraphs == 0) & (tables == 0), 0.25, BARE),
        (screenshot, 0.3, SCREENSHOT),
        (empty_ratio >= 0.75, 0.15, EMPTY_CELLS),
        (embedded > 0, 0.08, EMBEDDED),
    ]
    penalty = sum((F.when(test, cost).otherwise(0.0) for test, cost, _ in rules), F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - penalty)), 4)
    said = F.array_compact(F.array(*[F.when(test, F.lit(m)) for test, _, m in rules]))
    return F.struct(score.alias("score"), screenshot.alias("screenshot_like"), (screenshot | (score < 0.68)).alias("needs_supplement"), said.alias("messages"))


def match_score(supported: Column, weak: Column, missing: Column) -> Column:
    """struct(mastered, partial, gap, score) in whole percent; halves round to even."""
    total = F.greatest(supported + weak + missing, F.lit(1))
    mastered, partial = F.bround(supported * 100 / total, 0), F.bround(weak * 100 / total, 0)
    gap, score = F.greatest(F.lit(0), 100 - mastered - partial), F.least(F.lit(100), mastered + F.bround(partial * 0.5, 0))
    return F.struct(*[c.cast("long").alias(n) for c, n in ((mastered, "mastered"), (partial, "partial"), (gap, "gap"), (score, "score"))])


def visual_decision(distance: Column, diff: Column, near: int = 4, margin: int = 2, same: float = 0.03, flip: float = 0.08) -> Column:
    """Whether a frame repeats another, by Hamming distance of hashes and mean pixel difference (each may be null)."""
    return (
        F.when(distance.isNull(), "new_visual")
        .when((distance <= near) & (diff <= same), "repeat_visual_confident")
        .when(diff >= flip, "new_visual")
        .when(distance <= near + margin, "ambiguous_visual")
        .when(diff <= max(flip, 2 * same), "ambiguous_visual")
        .otherwise("new_visual")
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def least_coverage(marked: Column, n: Column, relaxed: Column) -> Column:
    """How many of n questions must be covered: fewer for material that reads like speech, and in relaxed mode."""
    speech = (marked >= 3) & (marked / F.greatest(n, F.lit(1)) >= 0.08)
    share = F.when(relaxed, 0.45).when(speech, 0.65).otherwise(0.85)
    return F.when(n <= 0, 0).otherwise(F.least(n, F.greatest(F.lit(1), F.ceil(n * share)))).cast("long")


def scaled(score: Column, by: list[str], tied: str) -> Column:
    """Min-max within a run. If all scores are equal: `one_if_positive`, `clamp` (to 0..1) or `one`."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    ties = {"one_if_positive": F.when(score > 0, 1.0).otherwise(0.0), "clamp": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), "one": F.lit(1.0)}
    return F.when(high > low, (score - low) / (high - low)).otherwise(ties[tied])


def best_match(pairs: DataFrame, question: list[str], candidate: str, least: float = 0.18) -> DataFrame:
    """Per question the candidate with the highest score, if it is high enough and strictly ahead of the next."""
    w = Window.partitionBy(*question).orderBy(F.desc("score"), candidate)
    ranked = pairs.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    ahead = F.col("_next").isNull() | (F.col("score") > F.col("_next"))
    return ranked.filter((F.col("_n") == 1) & (F.col("score") >= least) & ahead).drop("_n", "_next")


def key_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the character bigrams of the letters and digits."""
    return T.jaccard(T.char_ngrams(T.dedupe_key(a), 2), T.char_ngrams(T.dedupe_key(b), 2))


def set_fingerprint(rows: DataFrame, key: str, member: Column) -> DataFrame:
    """A digest of each key's distinct members that does not depend on their order."""
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(member)), ","), 256).alias("fingerprint"))


def sections(chunks: DataFrame) -> DataFrame:
    """chunks (document_id, section, position, text) to sections in order of first sight, texts joined in order of position."""
    g = chunks.groupBy("document_id", "section").agg(F.min("position").alias("first"), F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("position", "text"))).alias("c"))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("first", "section")) - 1
    return g.select("document_id", "section", order.cast("long").alias("place"), "n_chunks", F.array_join(F.col("c.text"), "\n").alias("text"))


def spans_to_evidence(spans: DataFrame, evidence: DataFrame, gap: int = 2) -> DataFrame:
    """Which pieces of evidence each character span touches; a document is its pieces in order, `gap` characters apart.

    spans: (document_id, span, s, e); evidence: (document_id, piece, size). Half-open; a join over buckets of offsets.
    """
    from .timeline import overlap_join

    before = F.sum(F.col("size") + gap).over(Window.partitionBy("document_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    placed = evidence.withColumn("rs", F.coalesce(before, F.lit(0))).withColumn("re", F.col("rs") + F.col("size")).filter("size > 0")
    return overlap_join(spans.filter("e > s"), placed, ["document_id"], 512).select("document_id", "span", "piece")
