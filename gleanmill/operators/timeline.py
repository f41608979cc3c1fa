"""Media time lines: segments of cues, overlap joins, and near-duplicate frames.

A segment ends after a span or a number of cues, which resets a counter, so it is folded in order per document;
everything else is a native plan. A document's cues or frames are the unit of one group map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_breaks(values: Iterable[tuple], starts_new: Callable[[list[tuple], tuple], bool]) -> list[int]:
    """Segment numbers of rows in order; starts_new sees the open segment and the next row."""
    out, held, n = [], [], -1
    for v in values:
        if not held or starts_new(held, v):
            held, n = [], n + 1
        held.append(v)
        out.append(n)
    return out


def segments(cues: DataFrame, span: int = 120, most: int = 6) -> DataFrame:
    """cues: (document_id, cue, start, end). A new segment when start - first start >= span or after `most` cues."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "cue"])
        return pdf.assign(segment=fold_breaks(zip(pdf["start"], strict=True), lambda held, v: v[0] - held[0][0] >= span or len(held) >= most))[["document_id", "cue", "segment"]]

    return cues.groupBy("document_id").applyInPandas(run, "document_id long, cue long, segment long")


def packed(items: DataFrame, most: int, chars: int) -> DataFrame:
    """items: (document_id, item, size). A new batch when it would hold more than `most` items or `chars` characters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        return pdf.assign(batch=fold_breaks(zip(pdf["size"], strict=True), lambda held, v: len(held) >= most or sum(h[0] for h in held) + v[0] > chars))[["document_id", "item", "batch"]]

    return items.groupBy("document_id").applyInPandas(run, "document_id long, item long, batch long")


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], width: int) -> DataFrame:
    """Rows of equal key whose half-open intervals [s, e) and [rs, re) overlap, each pair once.

    Both sides are exploded over buckets of `width`; a pair is kept in the first bucket that both reach, so no
    distinct is needed and no bucket is larger than what happens within it.
    """
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    a, b = left.withColumn("_b", buckets("s", "e")), right.withColumn("_b", buckets("rs", "re"))
    first = F.col("_b") == F.floor(F.greatest("s", "rs") / width)
    return a.join(b, [*key, "_b"]).filter(first & (F.col("s") < F.col("re")) & (F.col("rs") < F.col("e"))).drop("_b")


def best_frames(joined: DataFrame, segment: list[str], score: Column, frame: str, k: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*segment).orderBy(score.desc(), frame))
    return joined.withColumn("place", rank.cast("long")).filter(F.col("place") <= k)


def frame_clusters(frames: DataFrame, gap: int = 180, near: float = 0.86, short: int = 12) -> DataFrame:
    """Greedy clusters of frames with nearly the same text, in time order per document.

    frames: (document_id, frame, second, text). A frame joins the latest cluster whose last frame is at most `gap`
    seconds back and whose representative (the longest text) is alike: equal if short, else by 3-gram Jaccard.
    """

    def grams(t: str) -> set[str]:
        t = "".join(t.lower().split())
        return {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["second", "frame"])
        clusters: list[dict] = []
        number = []
        for second, text in zip(pdf["second"], pdf["text"].fillna(""), strict=True):
            own = grams(text)
            for c in reversed(clusters):
                if second - c["last"] > gap:
                    continue
                alike = text == c["text"] if min(len(text), len(c["text"])) < short else len(own & c["grams"]) / max(len(own | c["grams"]), 1) >= near
                if alike:
                    break
            else:
                c = {"id": len(clusters), "text": "", "grams": set(), "last": second}
                clusters.append(c)
            c["last"] = second
            if len(text) > len(c["text"]):
                c |= {"text": text, "grams": own}
            number.append(c["id"])
        return pdf.assign(cluster=number)[["document_id", "frame", "cluster"]]

    return frames.groupBy("document_id").applyInPandas(run, "document_id long, frame long, cluster long")


def merged_cues(cues: DataFrame, overlap: int = 2, back: int = 6) -> DataFrame:
    """cues (document_id, start, end, text) in order without those that repeat one of the last `back` kept: equal or held
    texts that start within max(2, overlap) seconds. Cues go by start, end and text (null first); a null or blank text
    repeats nothing. Which were kept decides, so a document's cues are one array, folded natively; a cue lasts 0.2 seconds or more.
    """
    said = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    cue = F.struct("start", "end", "text", said.alias("said"))
    in_order = cues.groupBy("document_id").agg(F.array_sort(F.collect_list(cue)).alias("cues"))

    def step(kept: Column, c: Column) -> Column:
        repeats = lambda k: (k["said"] != "") & (F.abs(k["start"] - c["start"]) <= max(2, overlap)) & (F.contains(k["said"], c["said"]) | F.contains(c["said"], k["said"]))
        last = F.slice(kept, F.greatest(F.size(kept) - back + 1, F.lit(1)), back)
        return F.when((c["said"] != "") & F.exists(last, repeats), kept).otherwise(F.concat(kept, F.array(c)))

    kept = F.aggregate("cues", F.slice("cues", 1, 0), step)
    return in_order.select("document_id", F.posexplode(kept).alias("n", "c")).select("document_id", (F.col("n") + 1).alias("cue"), "c.start", F.greatest(F.col("c.start") + 0.2, F.col("c.end")).alias("end"), "c.text")
