"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its byte n-grams, hashed into a fixed number of buckets; a linear layer
and a softmax give the languages. Training is plain stochastic gradient descent in numpy on the driver, over a
bounded sample: at most MAX_PER_LANG texts of each language, of at most MAX_BYTES each and chosen by a hash of
id and text, cut into pieces of PIECE bytes (a last piece below LEAST_PIECE bytes is left out unless it is the whole text),
of which MAX_PIECES of a language at most, chosen by a seeded shuffle, are learned. Held-out pieces of the sample calibrate the temperature and the
rejection limit. As the model is linear, prediction needs one table of logits for each bucket.

Null texts and texts without a letter are `und` with score 0 and rejected. A text with a letter but no n-gram (one
byte) is judged by the bias alone. Equal texts get equal answers, ties between languages go to the first by name. Long
texts are read whole. An empty table, or one without labels, gives `und` everywhere (there is nothing to learn).
Columns besides doc_id, text and (for training) lang are ignored. Every language that labels name is learned; the
model and the sample grow with their number alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, chunks, kept, mix, only

BUCKETS = 1 << 16
DIM = 16
ORDERS = (2, 3)
PIECE = 240
MAX_PER_LANG = 300
MAX_BYTES = 20_000
MAX_PIECES = 3000
LEAST_PIECE = 20
EPOCHS = 4
#: A text is rejected below the score that this share of held-out right answers stays above, or below FLOOR.
KEEP = 0.999
FLOOR = 0.3

PREDICTED = "doc_id long, lang_pred string, score double, accepted boolean"


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams, ordered by where they start, and for each document the first of them."""
    n = len(data)
    wide = np.zeros(n + max(ORDERS), U64)
    wide[:n] = data
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    out, value = np.full((n, len(ORDERS)), -1, np.int32), np.zeros(n, U64)
    for k in range(max(ORDERS)):
        value = value * U64(257) + wide[k : k + n] + U64(1)
        if k + 1 in ORDERS:
            bucket = (mix(value, k + 1) >> U64(48)).astype(np.int32)
            out[:, ORDERS.index(k + 1)] = np.where(left > k, bucket, -1)
    return out, at


def _examples(texts: list[str]) -> list[np.ndarray]:
    out = []
    for t in texts:
        raw = np.frombuffer(t.lower().encode(), np.uint8)
        for s in range(0, len(raw), PIECE):
            if len(piece := raw[s : s + PIECE]) >= LEAST_PIECE or s == 0 and len(piece):
                f, _ = features(piece, np.array([0, len(piece)]))
                out.append(f[f >= 0])
    return out


def _table_scores(examples: list[np.ndarray], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.array([table[x].mean(axis=0) + bias for x in examples])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """rows: (text, lang). None if there is nothing to learn."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    xs, ys, held_x, held_y = [], [], [], []
    for k, lang in enumerate(langs):
        texts = [t for t, x in rows if x == lang]
        fit, held = [t for i, t in enumerate(texts) if i % 5 or len(texts) < 5], [t for i, t in enumerate(texts) if i % 5 == 0]
        for group, to_x, to_y in ((fit, xs, ys), (held, held_x, held_y)):
            pieces = _examples(group)
            pieces = [pieces[i] for i in rng.permutation(len(pieces))[:MAX_PIECES]]
            to_x += pieces
            to_y += [k] * len(pieces)
    if not xs:
        return None
    y = np.array(ys)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    batch, steps = 16, EPOCHS * (len(xs) // 16 + 1)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for s in range(0, len(order), batch):
            take = order[s : s + batch]
            rate = 1.0 * (1 - step / steps)
            step += 1
            ids, size = np.concatenate([xs[i] for i in take]), np.array([len(xs[i]) for i in take])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            mean = np.add.reduceat(emb[ids], starts, axis=0) / size[:, None]
            p = _softmax(mean @ w + b)
            p[np.arange(len(take)), y[take]] -= 1
            grad = (p @ w.T).astype(np.float32)
            w -= rate * (mean.T @ p).astype(np.float32) / 4
            b -= rate * p.sum(axis=0).astype(np.float32) / 40
            np.add.at(emb, ids, -rate * 4 * np.repeat(grad / size[:, None], size, axis=0).astype(np.float32))
    table = (emb @ w).astype(np.float32)
    model = Model(langs, table, b, 1.0, FLOOR)
    if held_x and len(langs) > 1:
        z, truth = _table_scores(held_x, table, b), np.array(held_y)
        losses = {t: -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.2, 5, 25)}
        model.temperature = float(min(losses, key=losses.get))
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        if len(right):
            model.limit = float(max(FLOOR, min(0.5, np.quantile(right, 1 - KEEP))))
    return model


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """The MAX_PER_LANG labelled texts of each language with the least hash of id and text, or all if there are fewer.

    Repeated rows have one hash and count once. The bound of each language is found first, over hashes alone, so what is
    collected is bounded by the languages, and a language with a text always gives one.
    """
    known = only(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= MAX_BYTES))
    hashed = known.select("lang", "text", F.xxhash64("doc_id", "text", F.lit("langid")).alias("h"))
    # Each task keeps the first rows of a language before the shuffle, as the plan limits a filtered row number early.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    bounds = hashed.select("lang", "h").distinct().withColumn("place", place).filter(F.col("place") <= MAX_PER_LANG).groupBy("lang").agg(F.max("h").alias("bound"))
    # One row for each language, as many as the model has: broadcast, so that no text is shuffled by its language.
    rows = hashed.join(F.broadcast(bounds), "lang").filter("h <= bound").groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def fit(docs: DataFrame) -> Model | None:
    return train(sample(docs))


def _told(m: Model, text: pa.Array, has_letter: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, number of the language, score, accepted) of runs of rows; without a letter the number is that of "und"."""
    for first, end, data, at in chunks(text, 1 << 18):
        f, _ = features(data, at)
        flat = f.ravel()
        logits = np.where((flat >= 0)[:, None], m.logits[flat], np.float32(0))
        some = np.flatnonzero(np.diff(at))
        z = np.zeros((len(at) - 1, len(m.langs)))
        if len(some):
            starts = at[:-1][some] * len(ORDERS)
            n = np.add.reduceat((flat >= 0).astype(np.int64), starts)
            z[some] = np.add.reduceat(logits, starts, axis=0, dtype=np.float64) / np.maximum(n, 1)[:, None] + m.bias
        p = _softmax(z / m.temperature)
        best, score = p.argmax(axis=1), p.max(axis=1)
        letter = np.array(has_letter.slice(first, end - first).to_pylist(), bool)
        best, score = np.where(letter, best, len(m.langs)), np.where(letter, score, 0.0)
        yield first, end, best, score, letter & (score >= m.limit)


def predict(docs: DataFrame, model: Model | None, *carried: str) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every document, and carried boolean columns; lang is not read."""
    texts = only(docs, "doc_id", "text", *carried).select("doc_id", F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), *carried)
    if model is None:
        return texts.select("doc_id", *carried, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for first, end, best, score, good in _told(m, batch.column(1), batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(names[best], pa.string()), pa.array(score), pa.array(good), *[batch.column(3 + k).slice(first, end - first) for k in range(len(carried))]], names=["doc_id", "lang_pred", "score", "accepted", *carried])

    return texts.mapInArrow(run, PREDICTED + "".join(f", {c} boolean" for c in carried))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents (all columns) whose language is told with enough confidence. Each row is judged by its own text, whatever its doc_id."""
    if model is None:
        return docs.filter(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the input

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *[good for *_, good in _told(shared.value, batch.column(0), batch.column(1))]])

    return kept(docs, keep, F.lower("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
