"""Frames against plain versions: hashes bit by bit, all pairs of hashes, and the two folds frame by frame."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import SF

from gleanmill.operators import frames as V
from gleanmill.plans.frames import _frames
from gleanmill.plans.catalog import QUERIES

SCHEMA = "video long, frame long, time long, pixels binary, h string, place long"


def plain_hashes(pixels):
    rows = [list(pixels[9 * r : 9 * r + 9]) for r in range(8)]
    square = [v for r in rows for v in r[:8]]
    bits = ["".join("01"[r[c] > r[c + 1]] for r in rows for c in range(8)), "".join("01"[v >= sum(square) / 64] for v in square)]
    return tuple(int(b, 2) - (1 << 64 if b[0] == "1" else 0) for b in bits)


def flipped(h, bits):
    x = h & (1 << 64) - 1
    for b in bits:
        x ^= 1 << b
    return x - (1 << 64 if x >> 63 else 0)


def apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


@pytest.fixture(scope="module")
def pictures(spark):
    r = random.Random(6)
    base = [bytes(r.randrange(256) for _ in range(72)) for _ in range(5)]
    data = []
    for k in range(300):
        p = bytearray(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3, 30])):
            p[r.randrange(72)] = r.randrange(256)
        data.append((k % 4, k if k % 50 else 7, 13 * (k // 3), bytes(p), "x", 1))
    data += [(1, 900, 5, None, "x", 1), (1, 901, 5, b"short", "x", 1), (9, 902, None, base[0], "x", 1), (None, 903, 1, base[0], "x", 1), (2, 904, 1, bytes(72), "x", 1), (2, 905, 1, bytes([255] * 72), "x", 1)]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


def test_hashes(pictures):
    got = V.with_hashes(pictures).collect()
    assert len(got) == pictures.count()
    for r in got:
        want = plain_hashes(r.pixels) if r.pixels is not None and len(r.pixels) == 72 else (None, None)
        assert (r.dhash, r.ahash) == want


@pytest.mark.parametrize("most", [0, 3, 4, 7])
def test_near_hashes_are_all_pairs(spark, most):
    r = random.Random(most)
    seeds = [r.getrandbits(64) - (1 << 63) for _ in range(12)]
    hashes = [(v % 3, flipped(r.choice(seeds), r.sample(range(64), r.randrange(9)))) for v in range(400)] + [(0, None), (1, seeds[0]), (1, seeds[0])]
    df = spark.createDataFrame([(v, k, h) for k, (v, h) in enumerate(hashes)], "video long, frame long, dhash long")
    got = sorted(map(tuple, V.near_hashes(df, most=most).collect()))
    own = {v: sorted({h for w, h in hashes if w == v and h is not None}) for v in range(3)}
    want = sorted((v, a, b, apart(a, b)) for v, hs in own.items() for a in hs for b in hs if a < b and apart(a, b) <= most)
    assert got == want
    near = {r.frame: r for r in V.near_frames(df, most=most).collect()}
    assert len(near) == len(hashes)
    for k, (v, h) in enumerate(hashes):
        n = None if h is None else sum((a, b) != (h, h) and h in (a, b) for w, a, b, _ in want if w == v)
        least = None if h is None else min(i for i, x in enumerate(hashes) if x == (v, h))
        assert (near[k].n_near, near[k].same) == (n, least)


def plain_events(rows, keep):
    """Frames of one video in order: what each one is, from the decisions as the rule words them."""
    seen, out, last, at, slide = [], [], None, 0, 0
    mean = lambda a, b: round(sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 72 / 255, 6)
    for frame, time, pixels in rows:
        h = plain_hashes(pixels)[0]
        near = min(range(len(seen)), key=lambda g: (apart(seen[g][0], h), g), default=None)
        if near is not None:
            bits, diff = apart(seen[near][0], h), mean(seen[near][1], pixels)
            if bits <= 4 and diff <= 0.03:
                out.append((frame, "repeat_visual_confident", near + 1, near + 1, None, bits, False))
                continue
        if near is None:
            what, suspect, bits, slide = "initial_slide", None, None, 1
        elif diff < 0.08:
            what, suspect = "ambiguous_visual", near + 1
        else:
            flip = mean(last, pixels) >= 0.08
            what, suspect, slide = "ppt_flip" if flip else "interval" if time - at >= keep else "new_visual", None, slide + flip
        seen.append((h, pixels))
        last, at = pixels, time
        out.append((frame, what, len(seen), suspect, None if what == "ambiguous_visual" else slide, bits, True))
    return out


def check_events(df, keep):
    by = {}
    for r in df.select("video", "frame", "time", "pixels").collect():
        if r.pixels is not None and len(r.pixels) == 72 and r.time is not None:
            by.setdefault(r.video, []).append((r.time, r.frame, r.pixels))
    want = sorted(((v, *e) for v, rows in by.items() for e in plain_events([(f, t, p) for t, f, p in sorted(rows)], keep)), key=str)
    got = sorted(((r.video, r.frame, r.trigger, r.group, r.suspect, r.slide, r.distance, r.ocr) for r in V.visual_events(df, keep).collect()), key=str)
    assert got == want
    return {e[2] for e in got}


def test_visual_events(spark, pictures):
    kinds = check_events(pictures, 30)
    assert {"initial_slide", "repeat_visual_confident", "ambiguous_visual"} <= kinds
    assert "ppt_flip" in kinds and V.visual_events(pictures.filter("false")).count() == 0


def test_visual_events_of_a_whole_table(spark):
    assert "ppt_flip" in check_events(_frames(spark, SF), 30)
    assert QUERIES["fm14_visual_events"](spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def plain_verified(rows, max_frames):
    """One pass over a video's events in order, with the two bounds as counters."""
    primary = [t for _, t, _, trigger, ocr in rows if ocr and trigger in V.PRIMARY]
    base = len(primary) if max_frames is None else max_frames
    left = max(1, int(base * 0.25)) if base > 0 else 0
    times = [t for _, t, *_ in rows]
    width = max(1, -(-(max(times) - min(times) + 1) // max(1, base)))
    filled, of, out = {t // width for t in primary}, {}, {}
    for frame, t, g, trigger, ocr in sorted(rows, key=lambda r: (r[1], r[0])):
        out[frame] = (False, None)
        if g is None:
            continue
        s = of.setdefault(g, {"first": t, "seen": t, "read": None, "n": 0})
        away, s["seen"] = t - s["seen"], t
        if ocr:
            s["read"] = t
        elif trigger == V.REPEAT and (t - (s["first"] if s["read"] is None else s["read"]) >= 900 or t // width not in filled or t - s["first"] >= 600 or away >= 1800):
            if s["n"] < 2 and left:
                s["n"], s["read"], left = s["n"] + 1, t, left - 1
                out[frame] = (True, None)
            else:
                out[frame] = (False, "per_group_limit" if s["n"] >= 2 else "global_budget")
    return out


@pytest.mark.parametrize("max_frames", [None, 0, 12])
def test_verified(spark, max_frames):
    r = random.Random(11)
    data, wanted = [], {}
    for video in range(25):
        span, rows = r.choice([300, 3000, 9000]), []
        for k in range(r.randrange(1, 120)):
            trigger = r.choice([V.REPEAT] * 4 + ["new_visual", "ambiguous_visual", "other"])
            rows.append((video * 1000 + k, r.randrange(span), r.choice(["a", "b", "c", "d", None]), trigger, trigger in V.PRIMARY))
        data += [(video, *x) for x in rows]
        wanted |= plain_verified(rows, max_frames)
    df = spark.createDataFrame(data, "video long, frame long, time long, group string, trigger string, ocr boolean").repartition(5)
    got = {x.frame: x for x in V.verified(df, max_frames).collect()}
    assert {k: (x.verified, x.skipped) for k, x in got.items()} == wanted
    assert all(x.trigger == "visual_verification" for x in got.values() if x.verified)
    if max_frames is None:
        assert {s for _, s in wanted.values()} == {None, "per_group_limit", "global_budget"}
    assert V.verified(df.filter("false")).count() == 0


def test_packed_bits():
    bits = np.zeros((2, 64), bool)
    bits[0, 0] = bits[1, 63] = True
    assert list(V._packed(bits)) == [-(1 << 63), 1]
