"""Best-fit packing: documents into as few sequences of bounded length as the method finds.

Each document is its token ids and an end token; only longer ones are cut, into pieces of the full length. Pieces
are dealt to groups of bounded size. A group starts from best fit in the order of the table; a swap-based local search
then moves one or two pieces, or exchanges one for one, one for two or two for one between any two underfull
sequences, whenever this raises the sum of squared fill, until a full pass over them finds no gain; sequences that
empty go. The pieces of those that stay underfull in their group are dealt anew and packed again, in further rounds,
until they fit into one group or a round gives no fewer sequences, whose packing is then left for the one before.

A null or empty text is the end token alone. Rows with the same doc_id, or none, are packed each on its own. A piece is
dealt by a hash of its row's place in the table of pieces too, so that groups keep their size where rows repeat; in a
group, ties are broken by doc_id, piece and checksum. A rerun over the same files gives the same packing. An empty table gives no rows. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, only
from .tokens import default_path, encoder

CAPACITY = 4096
END_ID = 1
#: Pieces of a group: what one task packs.
GROUP = 2_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long, fill long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids adds its ids as little-endian unsigned 16-bit numbers (the vocabulary is below 65,536)."""
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    end = int(END_ID).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = ids_of(text.as_py() or "") + end
                for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[s : s + 4 * capacity]
                    rows.append((doc, k, s // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, np.uint32).astype("<u2").tobytes()] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in enumerate(columns)], names=names[: len(columns)])

    return only(docs, "doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit of items in the given order; a bit for each free length finds the tightest bin."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for item, size in enumerate(lengths):
        if fits := mask >> size:
            gap = size + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                mask &= ~(1 << gap)
            bins[b].append(item)
            gap -= size
        else:
            b, gap = len(bins), capacity - size
            bins.append([item])
        by_gap[gap].append(b)
        mask |= 1 << gap
    return bins


class _Index:
    """The emptiest bin for each size of a piece (kind 0) and each sum of two (kind 1) that it could give."""

    NONE = 1 << 40

    def __init__(self, capacity: int) -> None:
        self.heaps: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.least = np.full((2, 2 * capacity + 2), self.NONE, np.int64)
        self.version: dict[int, int] = {}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, b: int, fill: int, sizes: list[int]) -> None:
        distinct, count = np.unique(np.array(sizes, np.int64), return_counts=True)
        self.keys[b] = distinct, sums(distinct, count)
        for kind, keys in enumerate(self.keys[b]):
            for key in keys.tolist():
                heapq.heappush(self.heaps[kind].setdefault(key, []), (fill, b, self.version.setdefault(b, 0)))
            self.least[kind, keys] = np.minimum(self.least[kind, keys], fill)

    def remove(self, b: int) -> None:
        self.version[b] += 1
        for kind, keys in enumerate(self.keys.pop(b)):
            for key in keys.tolist():
                heap = self.heaps[kind][key]
                while heap and self.version[heap[0][1]] != heap[0][2]:
                    heapq.heappop(heap)
                self.least[kind, key] = heap[0][0] if heap else self.NONE


def sums(distinct: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The distinct sums of two pieces."""
    a, b = np.triu_indices(len(distinct), 1)
    return np.unique(np.concatenate([distinct[a] + distinct[b], 2 * distinct[count > 1]]))


def _two(items: list[int], lengths: list[int], total: int) -> list[int]:
    at: dict[int, int] = {}
    for i in items:
        if total - lengths[i] in at:
            return [at[total - lengths[i]], i]
        at[lengths[i]] = i
    raise ValueError("no two pieces have this sum")


def _step(index: _Index, fill: int, sizes: list[int], gap: int) -> tuple[int, int, int, int] | None:
    """The exchange that fills most of a gap and raises the sum of squares: (gain, kind, size or sum received, size or sum given).

    It does if the bin becomes fuller than the giver was. The bin itself is not in the index.
    """
    distinct, count = np.unique(np.array(sizes, np.int64), return_counts=True)
    zero = np.zeros(1, np.int64)
    best: tuple[int, int, int, int] | None = None
    for kind, given in ((0, np.concatenate([zero, distinct, sums(distinct, count)])), (1, np.concatenate([zero, distinct]))):
        for high in range(gap, best[0] if best else 0, -64):
            gains = np.arange(high, max(high - 64, best[0] if best else 0), -1)
            at = given[:, None] + gains[None, :]
            good = index.least[kind, np.minimum(at, index.least.shape[1] - 1)] < fill + gains[None, :]
            some = np.flatnonzero(good.any(axis=0))
            if len(some):
                g = int(gains[some[0]])
                r = int(given[np.flatnonzero(good[:, some[0]])[0]])
                best = g, kind, r + g, r
                break
    return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Raises the sum of squared fill by moves and exchanges between any two underfull bins until none helps; drops bins that empty.

    Fuller bins are filled first, each by the exchange that fills most of its gap, so most are full after one step
    and take no further part.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    index = _Index(capacity)
    under = {b for b in range(len(bins)) if 0 < fill[b] < capacity}
    for b in under:
        index.add(b, fill[b], [lengths[i] for i in bins[b]])
    improved = True
    while improved:
        improved = False
        for high in sorted(under, key=lambda b: (-fill[b], b)):
            if high not in under:
                continue
            index.remove(high)
            while fill[high] < capacity and (step := _step(index, fill[high], [lengths[i] for i in bins[high]], capacity - fill[high])):
                gain, kind, received, given = step
                heap = index.heaps[kind][received]
                while index.version[heap[0][1]] != heap[0][2]:
                    heapq.heappop(heap)
                low = heap[0][1]
                index.remove(low)
                own = [lengths[i] for i in bins[high]]
                out = _two(bins[low], lengths, received) if kind else [next(i for i in bins[low] if lengths[i] == received)]
                back = [] if not given else [bins[high][own.index(given)]] if given in own else _two(bins[high], lengths, given)
                bins[low] = [i for i in bins[low] if i not in out] + back
                bins[high] = [i for i in bins[high] if i not in back] + out
                fill[low] -= gain
                fill[high] += gain
                improved = True
                if fill[low]:
                    index.add(low, fill[low], [lengths[i] for i in bins[low]])
                else:
                    under.discard(low)
            if fill[high] < capacity:
                index.add(high, fill[high], [lengths[i] for i in bins[high]])
            else:
                under.discard(high)
    return [b for b in bins if b]


def pack_group(pdf: pd.DataFrame, capacity: int, group: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32", "length"]).reset_index(drop=True)
    lengths = pdf["length"].tolist()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    sequence, offset, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            sequence[i], offset[i] = group << 24 | k, at
            at += lengths[i]
        fill[b] = at
    return pdf.assign(sequence_id=sequence, offset=offset, fill=fill)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]]


def _round(rows: DataFrame, number: int, groups: int, capacity: int) -> DataFrame:
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(number)), F.lit(groups)).cast("int")

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_group(pdf, capacity, number << 30 | int(k[0]))

    return rows.withColumn("group", key).groupBy("group").applyInPandas(run, PLACED)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    rest, parts, underfull, before = cut(pieces(docs, path, capacity), "pieces"), [], None, None
    left = rest.count()
    for number in count():
        groups = max(1, -(-left // group))
        placed = cut(_round(rest, number, groups, capacity), "packed")
        begins, is_full = F.col("offset") == 0, F.col("fill") == capacity
        now, still, left = placed.agg(F.count_if(begins), F.count_if(begins & ~is_full), F.count_if(~is_full)).first()
        if before is not None and now >= before:
            parts.append(underfull)
            break
        underfull, before = placed.filter(~is_full).drop("fill"), still
        parts.append(placed.filter(is_full).drop("fill"))
        if not left or groups == 1:
            parts.append(underfull)
            break
        rest = underfull.drop("sequence_id", "offset")
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done
