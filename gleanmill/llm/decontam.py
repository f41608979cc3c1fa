"""Benchmark decontamination with spaced seeds.

Texts are lower-cased; words are runs of letters and digits. A seed is a fixed mask over a window of words; it
reads the words at its ones and ignores those at its zeros, so windows that differ by substitutions there still
hash alike. Hashes of benchmark and training windows are joined by Spark; at each hit the two texts are laid side by
side at the hit's shift, and the best run is kept if it is long and similar enough.

A bitmap of fixed size with the benchmark's hashes goes to the tasks and lets only windows through that may have a
partner, and with them the words of their documents; the join decides. So training text is read once, whatever the size
of the benchmark, only documents with hits are shuffled, and neither side is gathered in one place. A row of the join
carries the part of the document that lies beside the item. Seeds and items that many documents hit are counted first
and dealt to as many tasks as their counts ask for; the rows they give are the documents and items that share them.

Null and empty texts never match. Items with fewer words than a mask are sought as a whole. Every row of either table is
reported on its own, repeated rows and rows without an id too. Ties between runs go to the one with more equal words,
then to the one that starts first. Long texts are read whole. Documents or benchmark without rows give no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, U64, bounded_batches, chunks, counted_join, cut, mix, only, signed, word_hashes

#: Fixed masks: 1 is read, 0 is ignored.
MASKS = ("11101011", "1101001101", "110010100101", "1010110001011")
#: A run is reported if it has so many equal words (or the whole item, if that is shorter) ...
LEAST_WORDS = 10
#: ... and this share of its words is equal.
LEAST_SHARE = 0.8
#: A wrong word costs so much within a run that a run never bridges unrelated text.
COST = 3
#: Bits of the bitmap, as a power of two.
MAP_BITS = 27

FOUND = "doc_id long, item_id long, doc_start int, item_start int, n_words int, n_equal int, share double"

#: Bytes that part words: ASCII but for digits and letters.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def seeds(token: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of len(mask) words under the mask."""
    n = max(0, len(token) - len(mask) + 1)
    out = np.full(n, len(mask) * 1_000_003 + int(mask, 2), U64)
    for k, c in enumerate(mask):
        if c == "1" and n:
            out = (out ^ token[k : k + n]) * U64(0xD6E8FEB86659FD93)
            out ^= out >> U64(29)
    return out


def seeds_of(token: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows that lie within one document; first: the first word of each document, and their number."""
    h = seeds(token, mask)
    end = np.repeat(first[1:], np.diff(first))[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + len(mask) <= end)
    return at, h[at]


def own_masks(n: int) -> list[str]:
    """The masks by which an item of n words is sought."""
    return [m for m in MASKS if len(m) <= n] or ["1" * n]


def _items(benchmark: DataFrame) -> DataFrame:
    """(item: a key of its own, item_id, tokens: 64-bit word hashes) of each item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, at in chunks(batch.column(1)):
                token, first = word_hashes(data, at, SEPARATOR)
                some = np.flatnonzero(np.diff(first))
                raw = [token[first[k] : first[k + 1]].tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start).take(pa.array(some)), pa.array(raw, pa.binary())], names=["item_id", "tokens"])

    texts = only(benchmark, "item_id", "text").filter("text is not null").select("item_id", F.lower("text").alias("text"))
    return cut(texts.mapInArrow(run, "item_id long, tokens binary").withColumn("item", F.monotonically_increasing_id()), "items")


def _test_seeds(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                token = np.frombuffer(raw.as_py(), U64)
                for mask in own_masks(len(token)):
                    h = seeds(token, mask)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.full(len(h), item)), pa.array(np.arange(len(h), dtype=np.int32))], names=["seed", "item", "item_at"])

    return items.select("item", "tokens").mapInArrow(run, "seed long, item long, item_at int")


def _places(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash: its first bits, and its last ones."""
    return (seed >> U64(64 - MAP_BITS)).astype(np.int64), (seed & U64((1 << MAP_BITS) - 1)).astype(np.int64)


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The bits of all hashes, 2^MAP_BITS of them whatever the benchmark; words of 64 bits are put together by Spark."""
    bits = F.explode(F.array(F.shiftrightunsigned("seed", 64 - MAP_BITS), F.col("seed").bitwiseAND(F.lit((1 << MAP_BITS) - 1).cast("long"))))
    words = seeds.select(bits.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    got = words.toPandas()
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


def _maybe(bitmap: np.ndarray, seed: np.ndarray) -> np.ndarray:
    a, b = _places(seed)
    some = np.flatnonzero(bitmap[a >> 3] >> (a & 7).astype(np.uint8) & 1)
    return some[(bitmap[b[some] >> 3] >> (b[some] & 7).astype(np.uint8) & 1).astype(bool)]


def _hit_documents(docs: DataFrame, bitmap: np.ndarray, masks: list[str]) -> DataFrame:
    """(hit: a key of its own, doc_id, row, tokens, hits: array of seed and doc_at) of the documents with windows that may have a partner."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2^MAP_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, at in chunks(batch.column(2)):
                token, first = word_hashes(data, at, SEPARATOR)
                places, found = [], []
                for mask in masks:
                    p, h = seeds_of(token, first, mask)
                    some = _maybe(shared.value, h)
                    places.append(p[some])
                    found.append(h[some])
                place, seed = np.concatenate(places), np.concatenate(found)
                order = np.argsort(place, kind="stable")
                place, seed = place[order], seed[order]
                doc = np.searchsorted(first, place, "right") - 1
                some = np.unique(doc)
                if len(some):
                    ends = np.append(np.searchsorted(doc, some), len(doc)).astype(np.int32)
                    hits = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(signed(seed)), pa.array((place - first[doc]).astype(np.int32))], names=["seed", "doc_at"]))
                    raw = pa.array([token[first[k] : first[k + 1]].tobytes() for k in some], pa.binary())
                    rows = pa.array(start + some)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), raw, hits], names=["doc_id", "row", "tokens", "hits"])

    texts = only(docs, "doc_id", "text").filter("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.lower("text").alias("text"))
    found = texts.mapInArrow(run, "doc_id long, row long, tokens binary, hits array<struct<seed: long, doc_at: int>>")
    return cut(found.withColumn("hit", F.monotonically_increasing_id()), "hits")


def best_run(equal: np.ndarray) -> tuple[int, int]:
    """The run with the greatest number of equal words less COST for each wrong one."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -COST))])
    floor = np.minimum.accumulate(total)
    end = int(np.argmax(total - floor))
    return int(np.argmin(total[: end + 1])), end


def _verified(beside: DataFrame) -> DataFrame:
    """beside: (hit, item, doc_id, row, item_id, shift, low, n_item, part, other: words of both texts side by side). The runs that are long and similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            shifts, lows, sizes = (batch.column(k).to_pylist() for k in (5, 6, 7))
            for k, (part, other) in enumerate(zip(batch.column(8), batch.column(9), strict=True)):
                equal = np.frombuffer(part.as_py(), U64) == np.frombuffer(other.as_py(), U64)
                s, e = best_run(equal)
                n = int(equal[s:e].sum())
                if n >= min(LEAST_WORDS, sizes[k]) and n >= LEAST_SHARE * (e - s):
                    keep.append(k)
                    rows.append((n, lows[k] + s + shifts[k], lows[k] + s, e - s))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[:5], *[pa.array(c, pa.int32()) for c in columns]], names=["hit", "item", "doc_id", "row", "item_id", "n_equal", "doc_start", "item_start", "n_words"])

    return beside.mapInArrow(run, "hit long, item long, doc_id long, row long, item_id long, n_equal int, doc_start int, item_start int, n_words int")


def _found(docs: DataFrame, benchmark: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """The best run of each document and item, with the document's key `row`. Seeds and items found more than `hot` times go to several tasks."""
    bounded_batches(docs.sparkSession)
    items = _items(benchmark)
    n_words = (F.octet_length("tokens") / 8).cast("int")
    # Short items have masks of their own, at most one for each length below the shortest mask.
    sizes = [r[0] for r in items.select(F.least(n_words, F.lit(max(map(len, MASKS)))).alias("n")).distinct().collect()]
    masks = sorted({m for n in sizes for m in own_masks(n)})
    tested = _test_seeds(items)
    hit = _hit_documents(docs, _bitmap(tested), masks) if masks else None
    if hit is None:
        return docs.sparkSession.createDataFrame([], FOUND + ", row long")
    seen = cut(hit.select("hit", F.explode("hits").alias("h")).select("hit", "h.seed", "h.doc_at"), "seen")
    met = counted_join(seen, tested, ["seed"], ["hit", "doc_at"], hot)
    pairs = cut(met.select("hit", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct(), "pairs")
    of_item = items.select("item", "item_id", F.col("tokens").alias("b"), n_words.alias("n_item"))
    of_doc = hit.select("hit", "doc_id", "row", F.col("tokens").alias("a"), n_words.alias("n_doc"))
    beside = counted_join(pairs, of_item, ["item"], ["hit", "shift"], hot).join(of_doc, "hit")
    low = F.greatest(F.lit(0), -F.col("shift"))
    beside = beside.withColumn("low", low).withColumn("m", F.least("n_item", F.col("n_doc") - F.col("shift")) - F.col("low")).filter("m > 0")
    part, other = F.expr("substring(a, 8 * (low + shift) + 1, 8 * m)"), F.expr("substring(b, 8 * low + 1, 8 * m)")
    runs = _verified(beside.select("hit", "item", "doc_id", "row", "item_id", "shift", "low", "n_item", part.alias("part"), other.alias("other")))
    best = F.max(F.struct("n_equal", (-F.col("doc_start")).alias("back"), "item_start", "n_words")).alias("best")
    out = runs.groupBy("hit", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("row").alias("row"), best)
    return out.select("doc_id", "item_id", (-F.col("best.back")).alias("doc_start"), "best.item_start", "best.n_words", "best.n_equal", (F.col("best.n_equal") / F.col("best.n_words")).alias("share"), "row")


def overlaps(docs: DataFrame, benchmark: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """A row for each document and item with a common run: where it starts, its words, and how many are equal."""
    return _found(docs, benchmark, hot).drop("row")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) without a passage of the benchmark. Each row is judged by its own text, whatever its doc_id."""
    spoilt = _found(docs, benchmark).select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", F.xxhash64("doc_id", "text")).join(cut(spoilt, "spoilt"), "__row", "left_anti").select(*docs.columns)
