"""Training-order materialisation: a keyed permutation gives every sequence a global slot.

Documents become sequences of at most `length` token ids. A sequence's index is its place in the written table of
sequences (files in order, rows in order); a keyed Feistel network over the next even power of two, walked along
its cycle until it falls below the count, permutes the indices. The permutation needs no table and no shuffle of
its own, so any slot can be found again from the key. Sequences are range-partitioned by shard, and a shard is one run
of bytes: it holds a fixed number of slots, a slot a fixed number of bytes (16-bit little-endian ids, the rest zero),
so the sequence of a slot lies at (slot mod slots) times stride, and reading can start or resume at any slot. An index
says which piece of which document a slot holds.

A null or empty text is one sequence with the end token alone. Repeated rows get slots of their own. An empty
table gives no shards. Columns besides doc_id and text are ignored. A written table and its shards are bound to
one run: a rerun over other files may deal other indices.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .packing import pieces

LENGTH = 2048
SLOTS_PER_SHARD = 256
FEISTEL_ROUNDS = 6
KEY = 0x5EED_2024
BYTES_PER_ID = 2
#: Bytes of the shards of a file, about: what a task holds of them when it reads.
FILE_BYTES = 32 << 20


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round_key(key: int, k: int) -> int:
    x = (key + 0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ x >> 27) & (1 << 63) - 1


def feistel(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 (or its inverse) applied to x."""
    half = _half_bits(n)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_round_key(key, k)) for k in range(FEISTEL_ROUNDS)]

    def f(v: np.ndarray, k: np.uint64) -> np.ndarray:
        v = (v ^ k) * np.uint64(0xD6E8FEB86659FD93)
        return (v ^ v >> np.uint64(32)) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in reversed(keys) if inverse else keys:
            left, right = (right ^ f(left, k), left) if inverse else (right, left ^ f(right, k))
        return left << np.uint64(half) | right

    x = once(np.asarray(x, np.uint64))
    while (out := x >= np.uint64(n)).any():  # expected rounds: below four, as the domain is below 4 n
        x[out] = once(x[out])
    return x.astype(np.int64)


def _slot(n: int, key: int):
    @F.pandas_udf("long")
    def slot(index):
        import pandas as pd

        return pd.Series(feistel(index.to_numpy(), n, key))

    return slot


def materialise(docs: DataFrame, out: str | None = None, length: int = LENGTH, per_shard: int = SLOTS_PER_SHARD, key: int = KEY, path: str | None = None) -> str:
    """Writes shards and index under `out` (default: in the shared folder) and returns it.

    shards: (shard, n_slots, stride, payload), a row a shard, payload of n_slots * stride bytes. index: (doc_id, piece,
    start, length, ids_crc32, slot, shard, at), `at` the place of the slot in the payload of its shard. Files hold
    ranges of shards in order, about FILE_BYTES each.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    staged = f"{out}-staged"
    pieces(docs, path, length, with_ids=True).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.parquet(staged).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    counts = sorted((r["file"], r["n"]) for r in rows.groupBy("file").agg((F.max("row") + 1).alias("n")).collect())  # a row for each written file
    n = sum(c for _, c in counts)
    before = dict(zip([f for f, _ in counts], np.cumsum([0, *[c for _, c in counts]])[:-1].tolist(), strict=True))
    bases = spark.createDataFrame(list(before.items()) or [("", 0)], "file string, base long")
    stride = BYTES_PER_ID * length
    dealt = rows.join(F.broadcast(bases), "file").withColumn("slot", _slot(max(n, 1), key)(F.col("base") + F.col("row")))
    dealt = dealt.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))
    shards = max(1, -(-n // per_shard))
    ordered = dealt.repartitionByRange(min(shards, max(1, n * stride // FILE_BYTES) + 8), "shard").sortWithinPartitions("slot")
    placed = ordered.select("doc_id", "piece", "start", "length", "ids_crc32", "slot", "shard", ((F.col("slot") % per_shard) * stride).alias("at"), "ids")
    _laid(placed, stride).write.option("compression", "zstd").partitionBy("kind").parquet(out)
    return out


_INDEX = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long, shard long, at long"


def _laid(placed: DataFrame, stride: int) -> DataFrame:
    """Index rows as they come, and after the last of a shard its bytes. A partition holds whole shards in order of slot."""
    names = [*[x.split()[0] for x in _INDEX.split(", ")], "n_slots", "payload", "kind"]
    ints = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, bytearray()

        def whole() -> pa.RecordBatch:
            columns = [pa.nulls(1, t) for t in ints]
            columns[6], columns[8] = pa.array([shard], pa.int64()), pa.array([len(held) // stride], pa.int64())
            return pa.RecordBatch.from_arrays([*columns, pa.array([bytes(held)], pa.binary()), pa.array(["shards"])], names=names)

        for batch in batches:
            for now, ids in zip(batch.column(6).to_pylist(), batch.column(8), strict=True):
                if now != shard:
                    if held:
                        yield whole()
                    shard, held = now, bytearray()
                held += ids.as_py().ljust(stride, b"\0")
            some = pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.binary()), pa.array(["index"] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], *some], names=names)
        if held:
            yield whole()

    return placed.mapInArrow(run, f"{_INDEX}, n_slots long, payload binary, kind string")


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, slot, shard, at) of every sequence."""
    return spark.read.schema(f"{_INDEX}, kind string").parquet(out).filter("kind = 'index'").drop("kind")


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """(shard, n_slots, payload)."""
    return spark.read.schema("shard long, n_slots long, payload binary, kind string").parquet(out).filter("kind = 'shards'").drop("kind")


def read_slots(spark: SparkSession, out: str, first: int = 0, end: int | None = None, length: int = LENGTH, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(slot, payload) of slots first..end-1 in order; shards outside the range are skipped by their statistics."""
    stride = BYTES_PER_ID * length
    rows = read_shards(spark, out).filter(F.col("shard") >= first // per_shard)
    rows = rows if end is None else rows.filter(F.col("shard") <= (end - 1) // per_shard)
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1), lambda i: F.struct((F.col("shard") * per_shard + i).alias("slot"), F.substring("payload", (i * stride + 1).cast("int"), F.lit(stride)).alias("payload")))
    slots = rows.select(F.explode(cut).alias("s")).select("s.slot", "s.payload").filter(F.col("slot") >= first)
    return (slots if end is None else slots.filter(F.col("slot") < end)).orderBy("slot")


def checksums(spark: SparkSession, out: str, length: int = LENGTH, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(slot, payload_crc32) as read back from the shards."""
    stride = BYTES_PER_ID * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(payload.as_buffer())
                sums = [zlib.crc32(raw[s : s + stride]) for s in range(0, len(raw), stride)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)) + shard * per_shard), pa.array(sums, pa.int64())], names=["slot", "payload_crc32"])

    return read_shards(spark, out).select("shard", "payload").mapInArrow(run, "slot long, payload_crc32 long")


def write_files(spark: SparkSession, out: str, folder: str) -> DataFrame:
    """Plain files shard-<number>.bin in a folder mounted on every executor. Each appears only when whole, so a rerun skips those that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = f"{folder}/shard-{shard:08d}.bin"
                if not os.path.exists(name):
                    part = f"{folder}/.shard-{shard:08d}-{uuid.uuid4().hex}"
                    try:
                        with open(part, "wb") as f:
                            f.write(payload.as_buffer())
                        os.replace(part, name)
                    finally:
                        if os.path.exists(part):
                            os.remove(part)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["shard"])

    return read_shards(spark, out).select("shard", "payload").mapInArrow(run, "shard long")
