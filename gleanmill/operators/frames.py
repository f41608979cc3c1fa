"""Frames of videos: perceptual hashes, near frames by Hamming distance, visual events, and frames promoted for verification.

Frames are rows (video, frame, time, pixels): `time` in whole seconds, `pixels` the grey values of a WIDTH x HEIGHT grid,
a byte each, row by row. Nulls and grids of another size have no hash and no difference; such a frame is no event.
Frames of equal time are taken in the order of `frame`. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The grid whose neighbours give the difference hash; the average hash takes its first eight columns.
WIDTH, HEIGHT = 9, 8
# Thresholds that results depend on.
NEAR, MARGIN, SAME, FLIP = 4, 2, 0.03, 0.08
VERIFY_RATIO, VERIFY_EACH, VERIFY_AFTER, STAY, REVISIT = 0.25, 2, 900, 600, 1800
REPEAT = "repeat_visual_confident"
PRIMARY = ("initial_slide", "ppt_flip", "interval", "new_visual", "ambiguous_visual")


def _packed(bits: np.ndarray) -> np.ndarray:
    """64 bits a row, the first one the highest, as signed longs."""
    return np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)


def grids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Grids of the rows that have one of the right size (the others zero), and which these are."""
    good = np.array([v is not None and len(v) == WIDTH * HEIGHT for v in column.to_pylist()], bool)
    out = np.zeros((len(column), HEIGHT, WIDTH), np.int16)
    if good.any():
        out[good] = np.frombuffer(b"".join(v for v, g in zip(column.to_pylist(), good, strict=True) if g), np.uint8).reshape(-1, HEIGHT, WIDTH)
    return out, good


def hashes_of(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference hash: whether a value is above its right neighbour. Average hash: whether it is at least the mean of eight columns."""
    square = grid[:, :, :8].reshape(-1, 64)
    return _packed((grid[:, :, :8] > grid[:, :, 1:]).reshape(-1, 64)), _packed(square * 64 >= square.sum(1, dtype=np.int64)[:, None])


def with_hashes(frames: DataFrame) -> DataFrame:
    """(video, frame, time, pixels, dhash, ahash); one Arrow map, no shuffle."""
    given = frames.select("video", "frame", "time", F.col("pixels").cast("binary").alias("pixels"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid, good = grids(batch.column(3))
            made = [pa.array(h, pa.int64(), mask=~good) for h in hashes_of(grid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "dhash", "ahash"])

    return given.mapInArrow(run, ", ".join([*kinds, "dhash long", "ahash long"]))


def near_hashes(hashed: DataFrame, name: str = "dhash", most: int = NEAR) -> DataFrame:
    """(video, near_a, near_b, distance): pairs of different hashes of a video that differ in at most `most` bits, a < b.

    Equal hashes are one row first. Of most + 1 blocks of bits two such hashes share one, so hashes meet on video, block
    and the block's bits only, and a pair that meets in several blocks counts in the first of them.
    """
    n = most + 1
    cuts = [64 * k // n for k in range(n + 1)]
    block = lambda c, k: F.shiftrightunsigned(F.shiftleft(c, 64 - cuts[k + 1]), 64 - cuts[k + 1] + cuts[k])
    one = hashed.filter(F.col(name).isNotNull()).select("video", F.col(name).alias("h")).distinct()
    dealt = one.select("video", "h", F.posexplode(F.array(*[block(F.col("h"), k) for k in range(n)])).alias("k", "bits"))
    met = dealt.withColumnRenamed("h", "near_a").join(dealt.withColumnRenamed("h", "near_b"), ["video", "k", "bits"]).filter("near_a < near_b")
    apart = F.col("near_a").bitwiseXOR(F.col("near_b"))
    earlier = [F.when((F.col("k") > k) & (block(apart, k) == 0), True) for k in range(n - 1)]
    return met.withColumn("distance", F.bit_count(apart)).filter((F.col("distance") <= most) & F.coalesce(*earlier, F.lit(False)).eqNullSafe(False)).select("video", "near_a", "near_b", "distance")


def near_frames(hashed: DataFrame, name: str = "dhash", most: int = NEAR) -> DataFrame:
    """A row a frame: its hash, the least frame of equal hash in its video, and how many other hashes of it are near. Frames without a hash have neither."""
    pairs = near_hashes(hashed, name, most)
    ends = pairs.select("video", F.explode(F.array("near_a", "near_b")).alias("h")).groupBy("video", "h").agg(F.count("*").alias("n_near"))
    of = hashed.filter(F.col(name).isNotNull()).groupBy("video", F.col(name).alias("h")).agg(F.min("frame").alias("same")).join(ends, ["video", "h"], "left")
    j = hashed.select("video", "frame", F.col(name).alias("h")).join(of, ["video", "h"], "left")
    return j.select("video", "frame", F.col("h").alias(name), "same", F.when(F.col("h").isNotNull(), F.coalesce("n_near", F.lit(0))).alias("n_near"))


_EVENT = [("video", pa.int64()), ("frame", pa.int64()), ("time", pa.int64()), ("trigger", pa.string()), ("group", pa.int64()), ("suspect", pa.int64()), ("slide", pa.int64()), ("distance", pa.int64()), ("ocr", pa.bool_())]
EVENT_SCHEMA = "video long, frame long, time long, trigger string, `group` long, suspect long, slide long, distance long, ocr boolean"


class _Video:
    """What has to be kept of a video while its frames pass: its groups' hashes and grids, the last event and the slide."""

    def __init__(self, video: int):
        self.video, self.slide, self.hashes, self.grids, self.last, self.at = video, 0, np.zeros(64, np.int64), [], None, 0

    def event(self, frame: int, time: int, grid: np.ndarray, value: int, keep: int) -> tuple | None:
        if self.last is None:
            self.slide = 1
            return self._told(frame, time, grid, value, "initial_slide", None, None, 1)
        near = np.bitwise_count((self.hashes[: len(self.grids)] ^ value).view(np.uint64))
        group = int(near.argmin())
        distance, diff, moved = int(near[group]), _difference(self.grids[group], grid), _difference(self.last, grid)
        if distance <= NEAR and diff <= SAME:
            return (self.video, frame, time, REPEAT, group + 1, group + 1, None, distance, False)
        if diff < FLIP and (distance <= NEAR + MARGIN or diff <= max(FLIP, 2 * SAME)):
            return self._told(frame, time, grid, value, "ambiguous_visual", group + 1, distance, None)
        flip, due = moved >= FLIP, time - self.at >= keep
        self.slide += flip
        return self._told(frame, time, grid, value, "ppt_flip" if flip else "interval" if due else "new_visual", None, distance, self.slide)

    def _told(self, frame, time, grid, value, trigger, suspect, distance, slide) -> tuple:
        if len(self.grids) == len(self.hashes):
            self.hashes = np.append(self.hashes, np.zeros_like(self.hashes))
        self.hashes[len(self.grids)] = value
        self.grids.append(grid.astype(np.uint8))
        self.last, self.at = grid, time
        return (self.video, frame, time, trigger, len(self.grids), suspect, slide, distance, True)


def _difference(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference of grey values, of 1."""
    return round(float(np.abs(a.astype(np.int16) - b).mean()) / 255.0, 6)


def visual_events(frames: DataFrame, keep_seconds: int = 30) -> DataFrame:
    """One event a frame: repeat of a group, ambiguous (a group of its own, under suspicion), or new (flip, interval or new).

    A frame is held against the nearest earlier group of its video (of equally near ones the first). Videos are dealt to
    tasks and each one's frames pass in order of time; what is kept is its groups, not its frames. The order within a
    video makes the events, so a video is one task's work; a third of all frames in one video is that video's length.
    """
    rows = with_hashes(frames).filter(F.col("dhash").isNotNull() & F.col("time").isNotNull())
    rows = rows.select(F.col("video").cast("long"), F.col("frame").cast("long"), F.col("time").cast("long"), "pixels", "dhash")
    dealt = rows.repartition("video").sortWithinPartitions("video", "time", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            grid, _ = grids(batch.column(3))
            out = []
            for k, (video, frame, time, value) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 4)], strict=True)):
                if state is None or state.video != video:
                    state = _Video(video)
                out.append(state.event(frame, time, grid[k], value, keep_seconds))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, (_, kind) in enumerate(_EVENT)], names=[n for n, _ in _EVENT])

    return dealt.mapInArrow(run, EVENT_SCHEMA)


def verified(events: DataFrame, max_frames: int | None = None) -> DataFrame:
    """(video, frame, time, group, trigger, verified, skipped): repeats that are read once more, so that small changes are not missed.

    A repeat is due if its group was last read VERIFY_AFTER seconds ago, has been there for STAY, was away for REVISIT, or
    falls in a stretch of the video without a primary event. At most VERIFY_EACH of a group are verified and a share of
    the video's primary events in all, first come first served; `skipped` names the bound that held a due one back.

    A group's promotions come from its own events (two rounds of windows over a group); as bounds only ever stop what
    follows, the video's bound keeps the first of these, at most two rows a group. No video is sorted as a whole.
    """
    primary = F.col("ocr") & F.col("trigger").isin(*PRIMARY)
    e = events.select("video", "frame", "time", F.col("group").alias("g"), "trigger", F.coalesce("ocr", F.lit(False)).alias("ocr"))
    base = F.count_if(primary) if max_frames is None else F.lit(max_frames).cast("long")
    video = e.groupBy("video").agg(base.alias("base"), (F.max("time") - F.min("time") + 1).alias("span"))
    most = F.when(F.col("base") > 0, F.greatest(F.lit(1), F.floor(F.col("base") * VERIFY_RATIO))).otherwise(0)
    video = video.select("video", most.alias("most"), F.greatest(F.lit(1), F.ceil(F.col("span") / F.greatest(F.lit(1), F.col("base")))).alias("width"))
    e = e.join(video, "video").withColumn("bucket", F.floor(F.col("time") / F.col("width")))
    filled = e.filter(primary).select("video", "bucket").distinct().withColumn("filled", F.lit(True))
    e = e.join(filled, ["video", "bucket"], "left")
    order = Window.partitionBy("video", "g").orderBy("time", "frame")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    first, ever = F.first("time").over(order), F.last(F.when(F.col("ocr"), F.col("time")), ignorenulls=True).over(so_far)
    e = e.withColumn("read", F.coalesce(ever, first)).withColumn("always", F.col("filled").isNull() | (F.col("time") - first >= STAY) | (F.col("time") - F.coalesce(F.lag("time").over(order), "time") >= REVISIT))
    repeat = F.col("g").isNotNull() & ~F.col("ocr") & (F.col("trigger") == REPEAT)

    def due(at: Column) -> Column:
        """Due when the group was last read at the later of its own readings and `at`."""
        return repeat & (F.col("always") | (F.col("time") - F.greatest("read", at) >= VERIFY_AFTER))

    mark = F.struct("time", "frame")
    e = e.withColumn("one", F.min(F.when(due(F.lit(None).cast("long")), mark)).over(Window.partitionBy("video", "g")))
    e = e.withColumn("two", F.min(F.when((mark > F.col("one")) & due(F.col("one.time")), mark)).over(Window.partitionBy("video", "g")))
    turn = F.when(mark == F.col("one"), 1).when(mark == F.col("two"), 2)
    place = F.row_number().over(Window.partitionBy("video").orderBy("time", "frame"))
    passed = e.filter(turn.isNotNull() & (F.lit(VERIFY_EACH) >= turn)).select("video", "time", "frame", "most", place.alias("place")).filter("place <= most").select("video", "time", "frame", F.lit(True).alias("passed"))
    e = e.join(passed, ["video", "time", "frame"], "left")
    before = F.count("passed").over(so_far)
    last = F.max(F.when(F.col("passed"), F.col("time"))).over(so_far)
    held = F.when(F.col("passed").isNull() & due(last), F.when(before >= VERIFY_EACH, "per_group_limit").otherwise("global_budget"))
    return e.select("video", "frame", "time", F.col("g").alias("group"), F.when(F.col("passed"), "visual_verification").otherwise(F.col("trigger")).alias("trigger"), F.col("passed").isNotNull().alias("verified"), held.alias("skipped"))
