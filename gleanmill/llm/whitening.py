"""Embedding whitening: moments by rank-one updates in each partition, merged in parallel, and a symmetric QR eigen-solve.

Every task runs Welford's update over its rows, vector by vector, and emits one row with the count, the exact sums, the
means and the centred products. Such rows are merged by the parallel formula, at most FAN of them to a row and on
executors, until FAN are left for the driver; their size is that of a matrix and does not grow with the table. The
covariance is brought to tridiagonal form by reflections and solved by implicit QR steps with shifts. A second pass
projects every row, and the same updates over the projections measure how far their covariance is from the identity.

Entries are whole numbers x = floor(SCALE c) + SHIFT of the double c. A row is left out if its vector is null, holds a
null, NaN or infinite entry, or an entry whose SCALE c lies beyond 2^50, which x could not hold exactly. Vectors of
another length than most remaining rows (of equally common lengths, the longer) are left out as well, as no covariance
covers both. Empty vectors have no component and give no row. A component without variance (its eigenvalue is below the
solver's precision) has a null `whitened`; where all are, `explained` is null too and `identity_error` null. Repeated
rows and rows of one vec_id count each; equal eigenvalues come in the solver's order, the same one for all rows. Extra
columns are ignored; an empty table gives no rows. A deviation beyond a long fails and does not wrap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, only

#: Fixed values of the contract.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Partial moments that are merged into one, and that the driver gets at most.
FAN = 16
_LIMIT = float(2**50)
_MOMENTS = "part long, n long, sums array<decimal(38,0)>, mean array<double>, products array<double>"


@dataclass(frozen=True)
class Moments:
    """Count, exact sums, means and sums of centred products."""

    n: int
    sums: list[int]
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def none(d: int) -> Moments:
        return Moments(0, [0] * d, np.zeros(d), np.zeros((d, d)))

    def merged(self, other: Moments) -> Moments:
        """The parallel update: both products and the outer product of the difference of means, weighed by n m / (n + m)."""
        if not self.n or not other.n:
            return other if not self.n else self
        n, apart = self.n + other.n, other.mean - self.mean
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return Moments(n, sums, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))


@dataclass(frozen=True)
class Whitening:
    """What fit learns: n, the exact sums, the components as rows, their eigenvalues and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the remaining rows, x null-free."""
    entry = lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) <= _LIMIT)  # noqa: E731  NaN is above every number
    good = only(vectors, "vec_id", "embedding").filter(F.col("embedding").isNotNull() & F.forall("embedding", entry))
    lengths = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return good.filter(F.size("embedding") == (lengths["d"] if lengths else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _welford(batches: Iterator[pa.RecordBatch], d: int, to_values) -> Iterator[pa.RecordBatch]:
    """One row of moments for the partition; to_values: what of a batch is summed, a matrix and its exact sums."""
    n, sums, mean, products = 0, [0] * d, np.zeros(d), np.zeros((d, d))
    for batch in batches:
        values, totals = to_values(batch)
        sums = [a + int(b) for a, b in zip(sums, totals, strict=True)]
        for row in values:
            n += 1
            apart = row - mean
            mean += apart / n
            products += apart[:, None] * (row - mean)
    yield _moments_batch([(TaskContext.get().partitionId(), Moments(n, sums, mean, products))])


def _moments_batch(rows: list[tuple[int, Moments]]) -> pa.RecordBatch:
    from decimal import Decimal

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
    columns = zip(*[(part, m.n, [Decimal(s) for s in m.sums], m.mean, m.products.ravel()) for part, m in rows], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["part", "n", "sums", "mean", "products"])


def _read_moments(row) -> Moments:
    return Moments(row["n"], [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["products"]).reshape(len(row["mean"]), -1))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments in the order of their parts, so that a task run again gives the same row."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
    if rows:
        total = _read_moments(rows[0])
        for r in rows[1:]:
            total = total.merged(_read_moments(r))
        yield _moments_batch([(rows[0]["part"], total)])


def _gathered(moments: DataFrame, parts: int, d: int) -> Moments:
    """Merges FAN rows to one, on executors, until the driver merges the rest."""
    while parts > FAN:
        parts = -(-parts // FAN)
        moments = moments.repartitionByRange(parts, "part").mapInArrow(_merge, _MOMENTS)
    total = Moments.none(d)
    for row in sorted(moments.collect(), key=lambda r: r["part"]):
        total = total.merged(_read_moments(row))
    return total


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """None if no row remains."""
    bounded_batches(vectors.sparkSession)
    x = scaled(vectors)
    first = x.first()
    if first is None or not first["x"]:
        return None
    d = len(first["x"])

    def to_values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        whole = _matrix(batch.column(0), d)
        return whole.astype(np.float64), whole.sum(0)

    whole = x.select("x")
    moments = _gathered(whole.mapInArrow(partial(_welford, d=d, to_values=to_values), _MOMENTS), whole.rdd.getNumPartitions(), d)
    values, axes = symmetric_qr(moments.products / moments.n)
    k = min(components, d)
    return Whitening(moments.n, moments.sums, axes[:, :k].T.copy(), values[:k], float(np.trace(moments.products / moments.n)))


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns: Householder reflections, then implicit QR steps."""
    d = len(a)
    a, axes = a.copy(), np.eye(d)
    for k in range(d - 2):  # a becomes tridiagonal
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        axes[:, k + 1 :] -= 2 * np.outer(axes[:, k + 1 :] @ v, v)
    diagonal, off = np.diag(a).copy(), np.append(np.diag(a, -1), 0.0)
    end = d - 1
    while end > 0:
        small = np.abs(off[:end]) <= np.finfo(float).eps * (np.abs(diagonal[:end]) + np.abs(diagonal[1 : end + 1]))
        off[:end][small] = 0
        if off[end - 1] == 0:
            end -= 1
            continue
        begin = int(np.flatnonzero(off[:end] == 0)[-1]) + 1 if (off[:end] == 0).any() else 0
        _qr_step(diagonal, off, axes, begin, end)
    order = np.argsort(-diagonal, kind="stable")
    axes = axes[:, order]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(d)])
    return diagonal[order], axes * signs


def _qr_step(diagonal: np.ndarray, off: np.ndarray, axes: np.ndarray, begin: int, end: int) -> None:
    """One QR step on rows begin..end, shifted by the eigenvalue of the last 2 x 2 block nearest to its corner; rotations chase the bulge down."""
    half, b = (diagonal[end - 1] - diagonal[end]) / 2, off[end - 1]
    x, z = diagonal[begin] - diagonal[end] + b * b / (half + np.copysign(np.hypot(half, b), half)), off[begin]
    for k in range(begin, end):
        r = np.hypot(x, z)
        c, s = (x / r, z / r) if r else (1.0, 0.0)
        if k > begin:
            off[k - 1] = r
        p, q, o = diagonal[k], diagonal[k + 1], off[k]
        diagonal[k], diagonal[k + 1] = c * c * p + 2 * c * s * o + s * s * q, s * s * p - 2 * c * s * o + c * c * q
        off[k] = c * s * (q - p) + (c * c - s * s) * o
        if k + 1 < end:
            x, z, off[k + 1] = off[k], s * off[k + 1], c * off[k + 1]
        left = axes[:, k].copy()
        axes[:, k] = c * left + s * axes[:, k + 1]
        axes[:, k + 1] = c * axes[:, k + 1] - s * left


def _projected(x: np.ndarray, model: Whitening, means: np.ndarray, live: np.ndarray) -> np.ndarray:
    """(x - S / n) on the components over the roots of their eigenvalues; means: S div n and S mod n as two rows, so that the whole part leaves exactly."""
    centred = (x - means[0].astype(np.int64)) - means[1] / model.n
    return centred @ model.components[live].T / np.sqrt(model.values[live])


def _deviation(x: np.ndarray, model: Whitening) -> np.ndarray:
    sums = model.sums
    far = max(abs(model.n * int(x.max(initial=0)) - min(sums)), abs(model.n * int(x.min(initial=0)) - max(sums)))
    if x.shape[1] * far * far < 2**63:
        apart = model.n * x - np.array(sums, np.int64)
        return (apart * apart).sum(1)
    exact = [sum((model.n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    if max(exact) >= 2**63:
        raise OverflowError("a deviation is beyond a long")
    return np.array(exact, np.int64)


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining row and component."""
    bounded_batches(vectors.sparkSession)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    x, d, k = scaled(vectors), model.components.shape[1], len(model.components)
    live = model.values > d * np.finfo(float).eps * max(1.0, abs(float(model.values[0]))) if model.trace > 0 else np.zeros(k, bool)
    means = np.array([[s // model.n for s in model.sums], [s % model.n for s in model.sums]], float)
    error = None
    if live.any():
        def to_values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            done = _projected(_matrix(batch.column(0), d), model, means, live)
            return done, np.zeros(done.shape[1])

        whole, m = x.select("x"), int(live.sum())
        measured = _gathered(whole.mapInArrow(partial(_welford, d=m, to_values=to_values), _MOMENTS), whole.rdd.getNumPartitions(), m)
        error = float(np.abs(measured.products / measured.n - np.eye(m)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _matrix(batch.column(1), d)
            done = np.full((len(whole), k), np.nan)
            done[:, live] = _projected(whole, model, means, live)
            n, flat = len(whole) * k, done.ravel()
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(whole)), k)))
            explained = np.tile(np.where(live, model.values, 0.0) / model.trace, len(whole)) if live.any() else None
            yield pa.RecordBatch.from_arrays([
                ids.cast(pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(whole))), pa.array(np.full(n, model.n, np.int64)),
                pa.array(np.repeat(_deviation(whole, model), k)), pa.array(flat, mask=np.isnan(flat)),
                pa.nulls(n, pa.float64()) if explained is None else pa.array(explained), pa.nulls(n, pa.float64()) if error is None else pa.array(np.full(n, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, schema)
