"""What the training-data operators share: cutting lineage, and vectorised hashing of words inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at once inside a task. A longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18

#: Rows of an Arrow batch.
BATCH_ROWS = 1000

#: Rows of one key that a join brings together in one task, about.
HOT_ROWS = 100_000
#: Keys that a join treats as frequent, at most.
HOT_KEYS = 4096

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Space, tab, line feed, vertical tab, form feed and carriage return part words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session without one gets a temporary one; a cluster must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long: the session's Arrow batches, in the JVM and in Python workers, get BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, salts: int = 4) -> DataFrame:
    """left joined with right, which has one row for each key: the rows of a frequent key go to `salts` tasks, by another column."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right: a key with more than `rows` rows in left goes to as many tasks as its count asks for, by other columns.

    left is read for the counts first, so it should be a written table. A frequent key has more than the HOT_KEYS-th part of
    left too, so there are fewer than HOT_KEYS of them whatever the input; these alone are broadcast. Null keys join nothing.
    """
    limit = max(rows, -(-left.count() // HOT_KEYS))
    salts = F.ceil(F.col("count") / limit).cast("int").alias("__salts")
    hot = cut(left.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys, salts), "hot")
    n = F.coalesce("__salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), n).cast("int")).drop("__salts")
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__salts")
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; other columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def kept(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray], *inputs: Column) -> DataFrame:
    """The rows (all columns) for which keep, given record batches of the inputs, says so.

    A row travels with its inputs through one map: nothing is joined, and null or repeated ids play no part.
    """
    n, names, schema = len(df.columns), [str(k) for k in range(len(inputs))], df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = pa.RecordBatch.from_arrays(batch.columns[n:], names=names)
            mask = pa.array(keep(given), pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:n], schema=pa.schema(list(batch.schema)[:n])).filter(mask)

    return df.select("*", *[c.alias(f"__input_{k}") for k, c in enumerate(inputs)]).mapInArrow(run, schema)


def least_by_hash(rows: DataFrame, salt: str, n: int) -> list[str]:
    """The texts of the n different rows (doc_id, text) with the least hash of both, or all if there are fewer.

    The n-th least hash is found first, over hashes alone; the texts up to it are read then. Repeated rows have one hash and
    count once, and rows that share an id, or have none, are told apart by their texts, so no table with a row gives an empty sample.
    """
    hashed = rows.select("text", F.xxhash64("doc_id", "text", F.lit(salt)).alias("h"))
    bound = hashed.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if bound is None:
        return []
    return [r["text"] for r in hashed.filter(F.col("h") <= bound).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^(n-1) and their inverses modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply, as in splitmix64)."""
    x = x + U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes: any substring's hash follows from two of them."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without copying them, and n + 1 offsets. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about `limit` bytes; whole texts always."""
    raw, at = buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and for each document the number of the first one (n + 1 numbers)."""
    gap = np.ones(len(data) + 1, bool)
    if len(data):
        gap[:-1] = space[data]
    inner = ~gap[:-1]
    begins = inner.copy()
    begins[1:] &= gap[:-2]
    starts_of_docs = at[:-1][at[:-1] < at[1:]]
    begins[starts_of_docs] = inner[starts_of_docs]
    finishes = inner & gap[1:]
    last = starts_of_docs[starts_of_docs > 0] - 1
    finishes[last] = inner[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and for each document the number of the first one."""
    start, end, first = words(data, at, space)
    return span_hash(prefix_hash(data), start, end), first


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
