"""Suffix-array deduplication of long byte strings over range-partitioned, locally sorted suffixes.

Every byte covered by a string of WINDOW bytes that also starts elsewhere goes. Sorting a suffix for each byte would
take many times the input, so suffixes are sampled by content: of the GRAM-byte strings inside a window the one with
the least hash is the window's anchor. Equal windows have equal anchors, so a window can only repeat if the suffix at
its anchor does.

Suffixes are compared in three passes, each finer than the one before and over what it left open: anchors with all
windows they stand for, cells of at most CELL windows at a fixed distance from the anchor, and single windows. A row
of a pass is a suffix: its first eight bytes (`lead`), a fingerprint of the bytes that all windows of the row share
(`core`) and one of all bytes of its windows (`span`). If a core is found once, no window of the row repeats; if a span
is found twice, all do; only rows with a repeated core and a span of their own go on, one row for each distinct span.

In each pass Spark samples splitters and range-partitions the suffixes by their leading tokens; each bucket is sorted
by a multikey quicksort and neighbours are compared; the first and last suffix of every bucket decide about runs that
cross a boundary. The last keys are row, place and copy (a number of its own for each row of the table), so a suffix
shared by any number of texts, or of repeated rows of one text, spreads over as many buckets as it needs.

Null text is empty. Texts below WINDOW bytes are kept whole. A row is told by its doc_id and text together: rows that
share a doc_id (or have none) are judged each by its own text, and repeated rows count as documents of their own, so
they remove each other. Ties do not arise: equal strings are all removed. An empty table gives no rows. Other columns
are ignored. Equality is by eight bytes and 64-bit fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, chunks, cut, mix, only, prefix_hash, signed, span_hash

WINDOW = 200
GRAM = 50
#: Windows of a cell.
CELL = 32
#: Suffixes that a bucket holds, about. The number of buckets follows from it, so a bucket's memory does not grow.
BUCKET = 200_000
#: Segments up to this size are ended by one stable sort of the words that are left.
SMALL = 2048

CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_NAMES = ["lead", "core", "span", "row", "place", "copy"]
_SUFFIX = ", ".join(f"{n} long" for n in _NAMES)
_FLAGS = ["core_again", "span_again", "first", "open", "edge"]


def anchors(data: np.ndarray, at: np.ndarray, prefix: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of a chunk, by place; windows of one anchor follow each other."""
    n = len(data)
    if n < window:
        return (np.zeros(0, np.int64),) * 3
    grams = n - gram + 1
    place = np.arange(grams)
    key = span_hash(prefix, place, place + gram) >> U64(32) << U64(32) | place.astype(U64)
    width = window - gram + 1
    padded = np.full(-(-grams // width) * width + width, ~U64(0), U64)
    padded[:grams] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(np.repeat(at[1:], np.diff(at)) - np.arange(n) >= window)
    anchor = (np.minimum(back[starts], ahead[starts + width - 1]) & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    return anchor[first], starts[first], np.diff(np.append(first, len(starts)))


def _lead(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, so that signed numbers sort as the bytes do."""
    lead = np.zeros(len(place), U64)
    for k in range(8):
        lead = lead << U64(8) | data[place + k].astype(U64)
    return signed(lead ^ U64(1 << 63))


def multikey_quicksort(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their words: parted by a pivot in the first word, rows equal to it go on with the next one."""
    order = np.arange(len(words[0]))
    waiting = [(0, len(order), 0)]
    while waiting:
        low, high, depth = waiting.pop()
        if high - low < 2 or depth == len(words):
            continue
        rows = order[low:high]
        if high - low <= SMALL:
            order[low:high] = rows[np.lexsort([w[rows] for w in reversed(words[depth:])])]
            continue
        key = words[depth][rows]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        less, equal, more = rows[key < pivot], rows[key == pivot], rows[key > pivot]
        order[low:high] = np.concatenate([less, equal, more])
        a, b = low + len(less), high - len(more)
        waiting += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _batch(rows: pa.Array, copy: pa.Array, lead: np.ndarray, core: np.ndarray, span: np.ndarray, place: np.ndarray, raw: pa.Array | None = None) -> pa.RecordBatch:
    columns = [pa.array(lead), pa.array(signed(core)), pa.array(signed(span)), rows, pa.array(place), copy, *([] if raw is None else [raw])]
    return pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "raw"][: len(columns)])


def anchor_suffixes(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """texts: (row, text, copy). A suffix for each anchor. place: first window, distance of the anchor, windows, and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, at in chunks(batch.column(1)):
                prefix = prefix_hash(data)
                anchor, start, n = anchors(data, at, prefix, window, gram)
                if len(anchor):
                    doc = np.searchsorted(at, start, "right") - 1
                    span = mix(span_hash(prefix, start, start + n - 1 + window) + (anchor - start).astype(U64), 3)
                    place = ((start - at[doc]) << 24 | (anchor - start) << 12 | n) << 1 | 1
                    here = pa.array(first + doc)
                    yield _batch(batch.column(0).take(here), batch.column(2).take(here), _lead(data, anchor), span_hash(prefix, anchor, anchor + gram), span, place)

    return texts.mapInArrow(run, _SUFFIX)


def cell_suffixes(asked: DataFrame, window: int, gram: int, cell: int) -> DataFrame:
    """asked: (row, text, places, copy). The cells of the anchors at these places, with the bytes of their windows.

    place: first window, windows, and whether an answer is needed. Cells of different anchors lie at the same distances
    from them, so equal windows are in like cells, and all windows of a cell hold its core.
    """
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in chunks(batch.column(1)):
                prefix = prefix_hash(data)
                lists = batch.column(2).slice(first, end - first)
                doc = np.repeat(np.arange(end - first), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                packed = lists.flatten().to_numpy(zero_copy_only=False)
                need, n = packed & 1, packed >> 1 & 0xFFF
                start = (packed >> 25) + at[doc]
                base = start + (packed >> 13 & 0xFFF) - reach
                low, high = (start - base) // cell, (start + n - 1 - base) // cell
                m = high - low + 1
                who = np.repeat(np.arange(len(m)), m)
                c = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m) + low[who]
                s = np.maximum(start[who], base[who] + c * cell)
                e = np.minimum((start + n)[who], base[who] + (c + 1) * cell)
                core_start, core_end = base[who] + np.minimum((c + 1) * cell, reach + 1) - 1, base[who] + c * cell + window
                core = mix(span_hash(prefix, core_start, core_end) + c.astype(U64), 5)
                span = mix(span_hash(prefix, s, e - 1 + window) + (s - base[who]).astype(U64), 6)
                raw = pa.array([data[a:b].tobytes() for a, b in zip(s, e - 1 + window, strict=True)], pa.binary())
                here = pa.array(first + doc[who])
                yield _batch(batch.column(0).take(here), batch.column(3).take(here), _lead(data, core_start), core, span, ((s - at[doc[who]]) << 12 | e - s) << 1 | need[who], raw)

    return asked.mapInArrow(run, _SUFFIX + ", raw binary")


def window_suffixes(cells: DataFrame, window: int) -> DataFrame:
    """cells: (row, place, raw, copy). A suffix for each window of a cell. place: window, and whether an answer is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, at in chunks(batch.column(2)):
                prefix = prefix_hash(data)
                n = np.maximum(np.diff(at) - window + 1, 0)
                who = np.repeat(np.arange(len(n)), n)
                inner = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                packed = batch.column(1).slice(first, len(n)).to_numpy()[who]
                here, cell = at[who] + inner, pa.array(first + who)
                value = span_hash(prefix, here, here + window)
                yield _batch(batch.column(0).take(cell), batch.column(3).take(cell), _lead(data, here), value, value, ((packed >> 13) + inner) << 1 | packed & 1)

    return cells.mapInArrow(run, _SUFFIX)


def neighbours(suffixes: DataFrame, buckets: int) -> DataFrame:
    """Suffixes in sorted buckets, compared with their neighbours; only repeated ones and the buckets' edges are returned.

    core_again, span_again: another suffix has the same; first: of the suffixes with this span in the bucket; open: in
    the run of this core are several spans, and one of them that needs an answer is found once.
    """
    dealt = suffixes.repartitionByRange(buckets, *_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        words = [table.column(k).to_numpy() for k in range(3)]
        order = multikey_quicksort(words)
        lead, core, span = (w[order] for w in words)
        same_core = np.zeros(len(order) + 1, bool)
        same_span = same_core.copy()
        same_core[1:-1] = (lead[1:] == lead[:-1]) & (core[1:] == core[:-1])
        same_span[1:-1] = same_core[1:-1] & (span[1:] == span[:-1])
        core_again, span_again = same_core[:-1] | same_core[1:], same_span[:-1] | same_span[1:]
        first, run_of = ~same_span[:-1], np.cumsum(~same_core[:-1]) - 1
        needs = ~span_again & (table.column(4).to_numpy()[order] & 1 == 1)
        runs = (np.bincount(run_of, first) > 1) & (np.bincount(run_of, needs) > 0)
        edge = np.zeros(len(order), bool)
        edge[[0, -1]] = True
        some = np.flatnonzero(core_again | edge)
        out = table.take(pa.array(order[some]))
        for name, flag in zip(_FLAGS, (core_again, span_again, first, runs[run_of], edge), strict=True):
            out = out.append_column(name, pa.array(flag[some]))
        del held, table
        yield from out.to_batches(max_chunksize=1 << 14)
        pa.default_memory_pool().release_unused()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema.fields)
    return dealt.mapInArrow(run, fields + "".join(f", {n} boolean" for n in _FLAGS))


def across(flagged: DataFrame) -> DataFrame:
    """Runs that cross a boundary, judged by the edges: two rows a bucket. They are written, so that Spark joins them by their size."""
    edges = flagged.filter("edge")
    cores = cut(edges.groupBy("lead", "core").agg((F.count("*") > 1).alias("core_cross")).filter("core_cross"), "cores")
    spans = cut(edges.groupBy("lead", "core", "span").agg((F.count("*") > 1).alias("span_cross")).filter("span_cross"), "spans")
    out = flagged.join(cores, ["lead", "core"], "left").join(spans, ["lead", "core", "span"], "left")
    crossing = F.coalesce("core_cross", F.lit(False))
    rest = [c for c in flagged.columns if c not in (*_NAMES[:3], *_FLAGS)]
    return out.select(*rest, (F.col("core_again") | crossing).alias("core_again"), (F.col("span_again") | F.coalesce("span_cross", F.lit(False))).alias("span_again"), "first", (F.col("open") | crossing).alias("open"))


def _needed() -> Column:
    return F.col("span_again") & (F.col("place").bitwiseAND(F.lit(1).cast("long")) == 1)


def _left_open(found: DataFrame) -> DataFrame:
    """One row for each span of an open run; those that were found again need no further answer and only serve to compare."""
    answered = F.shiftleft(F.shiftright("place", 1), 1)
    return found.filter("core_again and open and first").withColumn("place", F.when(F.col("span_again"), answered).otherwise(F.col("place")))


def _merged(raw: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in raw):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _buckets(spark, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // BUCKET))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """(row, spans: set of start and end bytes that overlap or touch at will) of rows with repeated strings; row is row_key()."""
    if not (8 <= gram <= window and window - gram < 4096 and 8 < window - cell):
        raise ValueError("gram must have 8 bytes and a cell fewer windows than a window has bytes")
    bounded_batches(docs.sparkSession)
    spark, bits = docs.sparkSession, lambda n: F.lit((1 << n) - 1).cast("long")
    texts = only(docs, "doc_id", "text").filter(F.octet_length("text") >= window).select(row_key().alias("row"), "text", F.monotonically_increasing_id().alias("copy"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors_found = across(cut(neighbours(anchor_suffixes(texts, window, gram), _buckets(spark, 2 * size // (window - gram + 1))), "anchors"))
    start, n = F.shiftright("place", 25), F.shiftright("place", 1).bitwiseAND(bits(12))
    whole = anchors_found.filter(_needed()).select("row", start.alias("s"), (start + n - 1 + window).alias("e"))
    listed = _left_open(anchors_found).groupBy("row").agg(F.collect_set("place").alias("places"))
    asked = texts.join(listed, "row").select("row", "text", "places", "copy")
    cells = cut(cell_suffixes(asked, window, gram, cell), "cells")
    cells_found = across(cut(neighbours(cells, _buckets(spark, cells.count())), "cells-found"))
    start, n = F.shiftright("place", 13), F.shiftright("place", 1).bitwiseAND(bits(12))
    of_cells = cells_found.filter(_needed()).select("row", start.alias("s"), (start + n - 1 + window).alias("e"))
    finer = _left_open(cells_found).select("row", "place", "raw", "copy")
    count = finer.agg(F.sum(n)).first()[0] or 0
    windows_found = across(cut(neighbours(window_suffixes(finer, window), _buckets(spark, count)), "windows-found"))
    start = F.shiftright("place", 1)
    of_windows = windows_found.filter(_needed()).select("row", start.alias("s"), (start + window).alias("e"))
    return whole.unionByName(of_cells).unionByName(of_windows).groupBy("row").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _cleaned(joined: DataFrame, schema: str, text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, value, raw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data, spans = (value.as_py() or "").encode(), _merged(raw.as_py() or [])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                left = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(left), len(spans), left.decode("utf-8", "ignore") if text else hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return joined.mapInArrow(run, schema)


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: bool = False) -> DataFrame:
    """A row per document: bytes, bytes removed, maximal removed runs, and the digest of what is left (or, with `text`, what is left)."""
    every = only(docs, "doc_id", "text").withColumn("row", row_key())
    joined = every.join(repeated_spans(docs, window, gram), "row", "left").select("doc_id", "text", "spans")
    return _cleaned(joined, CLEANED.replace("kept_sha256", "kept_text") if text else CLEANED, text)
