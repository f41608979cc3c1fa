"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Texts are lower-cased and cut into words at white space; a document is the set of its n-grams of words (a text shorter
than n words: the one n-gram of all its words). Documents with equal sets form one class of copies, of which one goes
on. Classes that share a band of MinHash values are candidates and meet in the bucket of that band; pairs without a
shared band are never linked, however they meet. Where buckets chain into a group of few blocks, the group is verified
at once and each set is shipped once for each block; a larger group is
verified bucket by bucket, where a pair counts in the first band that it shares, and a bucket whose members all share
an earlier band is left out. A bucket of any size is dealt to blocks of a bounded number of n-grams, each pair of blocks
in a task of its own, so no pair is ever a row and a set is shipped as often as its bucket has blocks.

Null and empty texts and texts of white space have no n-grams: each is a class of its own without links. Long texts are
read whole. Every row is a document of its own: where ids are null or repeated, rows are told apart by a key in order
of doc_id (null last) and text, so rows that repeat a doc_id and its text are copies of each other. Ties go to the
least doc_id. An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, chunks, cut, mix, only, salted_join, signed, word_hashes
from .components import components

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
MAX_HASHES = 96
#: n-grams of a block, about. A task holds the n-gram sets of two blocks. Up to SMALL_BLOCKS blocks are smaller, for
#: more tasks; more blocks are larger, as each set goes to as many tasks as there are blocks.
BLOCK_GRAMS = 2_000_000
SMALL_GRAMS, SMALL_BLOCKS = 250_000, 8
#: Sets and, about, n-grams of a tile, the part of a block that is compared at once.
TILE, TILE_GRAMS = 384, 150_000
#: n-grams counted at once when two blocks are compared.
COLUMNS = 4096

SIGNED = "doc_id long, d1 long, d2 long, n_grams int, bands array<long>"


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes that keeps a pair at the threshold with the target recall."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngram_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each document of a chunk, sorted within it, and n + 1 offsets."""
    token, first = word_hashes(data, at)
    count = np.diff(first)
    grams = np.zeros(max(0, len(token) - n + 1), U64)
    for k in range(n):
        grams = mix(grams + token[k : k + len(grams)], k + 1) if len(grams) else grams
    sets = []
    for s, c in zip(first[:-1], count, strict=True):
        if c >= n:
            sets.append(np.unique(grams[s : s + c - n + 1]))
        elif c:
            whole = np.zeros(1, U64)
            for k in range(c):
                whole = mix(whole + token[s + k], k + 101)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, U64))
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.cumsum([0, *map(len, sets)])


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240611)
        flips = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64)
        for batch in batches:
            for first, end, data, at in chunks(batch.column(1)):
                grams, offset = ngram_sets(data, at, n)
                size = np.diff(offset)
                some = np.flatnonzero(size)
                d1, d2 = np.zeros(len(size), U64), np.zeros(len(size), U64)
                keys = np.zeros((len(some), bands), U64)
                if len(some):
                    starts = offset[:-1][some]
                    d1[some], d2[some] = np.add.reduceat(mix(grams, 7), starts), np.add.reduceat(mix(grams, 8), starts)
                    for k, flip in enumerate(flips):
                        least = np.minimum.reduceat((grams ^ flip) * U64(0xD6E8FEB86659FD93), starts)
                        keys[:, k // rows] = mix(keys[:, k // rows] + least, k + 1)
                lists = np.zeros(len(size) + 1, np.int32)
                lists[1:][some] = bands
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(signed(d1)), pa.array(signed(d2)), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(np.cumsum(lists, dtype=np.int32), pa.array(signed(keys.ravel())))],
                    names=["doc_id", "d1", "d2", "n_grams", "bands"],
                )

    return docs.mapInArrow(run, SIGNED)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """docs: (node, text, others ...). The sorted n-gram hashes of each text in place of it."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields]
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in chunks(batch.column(1)):
                grams, offset = ngram_sets(data, at, n)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(offset) - 1, [None, pa.py_buffer((offset * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(grams))])
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), raw, *part.columns[2:]], names=[names[0], "grams", *names[2:]])

    return docs.mapInArrow(run, ", ".join([fields[0], "grams binary", *fields[2:]]))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each of `left` shares with each of `right`."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    row_a, row_b = np.repeat(np.arange(len(left)), [*map(len, left)]), np.repeat(np.arange(len(right)), [*map(len, right)])

    def place(x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, x), max(len(both) - 1, 0))
        hit = both[at] == x if len(both) else np.zeros(len(x), bool)
        at, row = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    (at_a, row_a), (at_b, row_b) = place(a, row_a), place(b, row_b)
    for low in range(0, len(both), COLUMNS):
        i, j = np.searchsorted(at_a, [low, low + COLUMNS]), np.searchsorted(at_b, [low, low + COLUMNS])
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        x[row_a[i[0] : i[1]], at_a[i[0] : i[1]] - low] = 1
        y[row_b[j[0] : j[1]], at_b[j[0] : j[1]] - low] = 1
        out += x @ y.T
    return out


def _roots(n: int, links: list[np.ndarray]) -> np.ndarray:
    """For each of n sets the least number that it reaches through links (pairs of numbers)."""
    root = np.arange(n)
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _forest(near: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Links that join what the links of a tile join, few of them: each row and column to the least number it reaches."""
    none = np.iinfo(np.int64).max
    of_row, of_column = i.copy(), j.copy()
    while True:
        row = np.minimum(of_row, np.where(near, of_column[None, :], none).min(axis=1, initial=none))
        column = np.minimum(of_column, np.where(near, row[:, None], none).min(axis=0, initial=none))
        if (row == of_row).all() and (column == of_column).all():
            return np.stack([np.concatenate([i, j]), np.concatenate([row, column])])
        of_row, of_column = row, column


def _tiles(of: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The sets of a block in tiles; a set with more n-grams than a tile is one of its own."""
    tile, n, grams, ends = 0, 0, 0, []
    for k in of:
        if n and (n == TILE or grams + size[k] > TILE_GRAMS):
            tile, n, grams = tile + 1, 0, 0
        n, grams = n + 1, grams + size[k]
        ends.append(tile)
    return np.split(of, np.flatnonzero(np.diff(ends)) + 1) if len(of) else []


def compare(sets: list[np.ndarray], block: np.ndarray, copies: np.ndarray, pair: tuple[int, int], threshold: float, bands: np.ndarray | None = None, band: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(links of each set counted in documents, number of the least set that it reaches) for the pairs between two blocks.

    With bands (a row of band keys for each set), only pairs that share a band count: any band if `band` is negative, else
    those that share no band before `band`, which the bucket of that band has.
    """
    size, links, joined = np.array([*map(len, sets)], np.float64), np.zeros(len(sets), np.int64), []
    tiles_a, tiles_b = (_tiles(np.flatnonzero(block == p), size) for p in pair)
    for low, i in enumerate(tiles_a):
        for start, j in enumerate(tiles_b):
            if pair[0] == pair[1] and start < low:
                continue
            shared = overlaps([sets[k] for k in i], [sets[k] for k in j])
            near = (shared > 0) & (shared >= threshold * (size[i][:, None] + size[j][None, :] - shared) - 1e-6)
            for k in range(band if bands is not None else 0):
                near &= bands[i, k][:, None] != bands[j, k][None, :]
            if bands is not None and band < 0 and near.any():
                near &= reduce(np.logical_or, [a[:, None] == b[None, :] for a, b in zip(bands[i].T, bands[j].T, strict=True)])
            same = pair[0] == pair[1] and start == low
            if same:
                np.fill_diagonal(near, False)
            links[i] += near @ copies[j]
            if not same:
                links[j] += near.T @ copies[i]
            if near.any():
                joined.append(_forest(near, i, j))
    return links, _roots(len(sets), joined)


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """members: (node, grams, n_copies, bands, unit, band, bi, bj, block), each pair of blocks together within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                node, raw, copies, bands, block = zip(*held, strict=True)
                node, band = np.array(node), key[1]
                links, root = compare([np.frombuffer(x, U64) for x in raw], np.array(block), np.array(copies), key[2:], threshold, np.array(bands), band)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root][some])], names=["node", "links", "root"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(9)]
            for node, grams, copies, bands, unit, band, bi, bj, block in zip(*columns, strict=True):
                if (now := (unit, band, bi, bj)) != key:
                    yield from flush()
                    key, held = now, []
                held.append((node, grams, copies, bands, block))
        yield from flush()

    return members.mapInArrow(run, "node long, links long, root long")


def _blocks(grams: Column) -> Column:
    return F.greatest(F.ceil(grams / BLOCK_GRAMS), F.least(F.ceil(grams / SMALL_GRAMS), F.lit(SMALL_BLOCKS))).cast("int")


def _units(banded: DataFrame, nodes: DataFrame, bands: int) -> DataFrame:
    """banded: (node, band, key) of shared buckets; nodes: (node, n_grams, bands). What each class is verified in: (node, units: array of unit, band, blocks).

    A unit is a group of chained buckets (band -1) if it has few blocks, else a bucket.
    """
    least = banded.groupBy("key").agg(F.min("node").alias("v"))
    groups = cut(components(banded.join(least, "key").select(F.col("node").alias("u"), "v")), "groups")
    sizes = groups.join(nodes.select("node", "n_grams"), "node").groupBy("root").agg(_blocks(F.sum("n_grams")).alias("blocks"))
    of_node = salted_join(groups, sizes, ["root"], "node")
    small = F.col("blocks") <= SMALL_BLOCKS
    whole = of_node.filter(small).select("node", F.struct(F.col("root").alias("unit"), F.lit(-1).alias("band"), "blocks").alias("unit"))
    single = cut(banded.join(of_node.filter(~small).select("node"), "node").join(nodes, "node"), "single")
    ends = [f(F.get("bands", F.lit(k))).alias(f"{name}{k}") for k in range(bands) for name, f in (("low", F.min), ("high", F.max))]
    buckets = single.groupBy("key", "band").agg(F.sum("n_grams").alias("grams"), *ends)
    again = reduce(Column.__or__, [(F.lit(k) < F.col("band")) & (F.col(f"low{k}") == F.col(f"high{k}")) for k in range(bands)])
    asked = buckets.filter(~again).select("key", _blocks(F.col("grams")).alias("blocks"))
    parted = salted_join(single, asked, ["key"], "node").select("node", F.struct(F.col("key").alias("unit"), "band", "blocks").alias("unit"))
    return whole.unionByName(parted).groupBy("node").agg(F.collect_list("unit").alias("units"))


def _joined(texts: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """jaccard_join over rows (doc_id, text) whose ids are distinct and not null."""
    bands, rows = choose_bands(threshold, recall)
    bounded_batches(texts.sparkSession)
    texts = texts.select("doc_id", F.lower("text").alias("text"))
    marked = cut(signatures(texts, n, bands, rows), "signed")
    some = marked.filter("n_grams > 0")
    copies = cut(some.groupBy("d1", "d2", "n_grams").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_copies")), "copies")
    first = some.join(copies.select(F.col("node").alias("doc_id"), "n_copies"), "doc_id")
    keyed = first.select(F.col("doc_id").alias("node"), F.posexplode("bands").alias("band", "value")).select("node", "band", F.xxhash64("band", "value").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("w")).filter("v <> w").select("key")
    banded = cut(keyed.join(shared, "key"), "banded")
    nodes = cut(first.withColumnRenamed("doc_id", "node").join(banded.select("node").distinct(), "node", "left_semi").select("node", "n_grams", "n_copies", "bands"), "nodes")
    members = nodes.select("node", "n_copies", "bands").join(_units(banded, nodes.select("node", "n_grams", "bands"), bands), "node")
    sets = _sets(members.join(texts.withColumnRenamed("doc_id", "node"), "node").select("node", "text", "n_copies", "bands", "units"), n)
    spread = sets.select("node", "grams", "n_copies", "bands", F.explode("units").alias("u")).select("node", "grams", "n_copies", "bands", "u.unit", "u.band", "u.blocks")
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("node", "grams", "n_copies", "bands", "unit", "band", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block")
    keys = ["unit", "band", "bi", "bj"]
    found = cut(_verified(spread.repartition(*keys).sortWithinPartitions(*keys), threshold), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    of_copies = copies.join(links, "node", "left").join(classes, "node", "left")
    of_copies = of_copies.select("d1", "d2", "n_grams", F.col("node").alias("copy_id"), "n_copies", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    out = marked.select("doc_id", "d1", "d2", "n_grams").join(of_copies, ["d1", "d2", "n_grams"], "left")
    alone = F.col("doc_id")
    return out.select("doc_id", F.coalesce("class_id", alone).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_id", alone).alias("copy_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "n_grams")


def _odd(docs: DataFrame) -> bool:
    """Whether an id is null or repeated."""
    return not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, `__row`, in order of doc_id (null last) and text."""
    return cut(docs.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn("__row", F.monotonically_increasing_id()), "keyed")


def jaccard_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document: (doc_id, class_id, n_links, copy_id, n_copies, n_grams).

    copy_id is the least doc_id with the same n-gram set and n_copies their number. n_links counts the other
    documents, copies included, whose Jaccard similarity to this one is at least the threshold. class_id is the
    least doc_id that can be reached through links (null if none of them has an id). A pair at the threshold is found
    with probability `recall`, nearer pairs with more.
    """
    rows = only(docs, "doc_id", "text")
    if not _odd(rows):
        return _joined(rows, n, threshold, recall)
    keyed = _keyed(rows)
    found = _joined(keyed.select(F.col("__row").alias("doc_id"), "text"), n, threshold, recall)
    for name in ("class_id", "copy_id", "doc_id"):
        found = found.withColumnRenamed(name, "__row").join(keyed.select("__row", F.col("doc_id").alias(name)), "__row").drop("__row")
    return found.select("doc_id", "class_id", "n_links", "copy_id", "n_copies", "n_grams")


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """One document (all columns) of each class, the one with the least doc_id.

    Where ids are null or repeated, rows are told apart as in `jaccard_join`: different texts under one id, or under
    none, stay.
    """
    if not _odd(docs):
        return docs.join(_joined(only(docs, "doc_id", "text"), kw.get("n", WORDS), kw.get("threshold", THRESHOLD), kw.get("recall", TARGET_RECALL)).filter("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")
    keyed = _keyed(docs)
    classes = jaccard_join(keyed.select(F.col("__row").alias("doc_id"), "text"), **kw)
    return keyed.join(classes.filter("doc_id = class_id").select(F.col("doc_id").alias("__row")), "__row", "left_semi").select(*docs.columns)
