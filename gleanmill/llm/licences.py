"""Licence scans: a trained paragraph classifier finds licence families, templates confirm them.

A paragraph is a run of lines with words; lines without words (blank, or a comment mark alone) part paragraphs. What
is classified are the short lines, and overlapping windows of words of about template length that run across line
breaks, as any mark, comment marks too, only parts words. Features are hashed word unigrams and bigrams; a
multinomial logistic regression over these sparse counts is trained in numpy by stochastic gradient descent on
variants of the templates and, as the unknown class, on lines of a bounded sample of documents (SAMPLE documents of
at most SAMPLE_BYTES, by a hash of their id) and on near misses. Held-out lines set the temperature and the limit
below which a line or window is unknown. One predicted with enough confidence is compared, with the words around it,
with the templates of its family, and only confirmed ones count; where families overlap, the one with more of its
word pairs there does.

Null and empty texts have no paragraphs. Repeated rows get equal answers. Long texts are read whole. An empty table
gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, least_by_hash, mix, only, prefix_hash, span_hash, word_hashes, words
from .decontam import SEPARATOR

#: Usual statements of each family, as they occur in texts.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "BSD": ("This code is released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
}
#: Lines that share words with licences and are none.
NEAR_MISSES = (
    "A driving licence is needed to rent a car.", "The general public was free to use the library.", "The software was released in May and the license fee was paid.",
    "The restaurant lost its liquor license.", "All rights reserved.", "The Apache people live in the southwest.", "He studied at MIT and used free software.", "Version 2.0 of the report is out.",
    "The commons was open to the creative public.", "The file is subject to the terms of the contract.", "Mozilla and the public.", "A copy of this documentation was obtained free of charge.",
)
UNKNOWN = "unknown"
BUCKETS = 1 << 16
SAMPLE = 200
SAMPLE_BYTES = 20_000
EPOCHS = 12
#: Share of held-out unknown lines that may pass the limit, and the least limit.
PASS = 0.0005
FLOOR = 0.6
#: Share of a template's words, in order of pairs, that a line must have, or of its own that the template has.
CONFIRM = 0.6
#: Words of a window; windows start at every quarter of their size. Longer lines are left to the windows.
SIZES = (8, 16, 32)
LINE = 64
#: Words whose windows are scored together.
TOKENS = 1 << 15

FOUND = "doc_id long, families array<string>, n_paragraphs long, score double"
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    families: list[str]
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float


def _grams(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of unigrams, and of the bigram that starts at each word but the last."""
    one = (mix(token, 11) >> U64(48)).astype(np.int64)
    two = (mix(token[:-1] * U64(3) + token[1:], 12) >> U64(48)).astype(np.int64)
    return one, two


def _line(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    token, _ = word_hashes(raw, np.array([0, len(raw)]), SEPARATOR)
    return np.concatenate(_grams(token)) if len(token) else np.zeros(0, np.int64)


def _scores(x: list[np.ndarray], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([w[f].sum(axis=0) / np.sqrt(len(f) + 1) + b for f in x])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(lines: list[str], seed: int = 3) -> Model:
    """lines: of ordinary documents; those that name a licence are left out of the unknown class."""
    r, families = random.Random(seed), [UNKNOWN, *sorted(TEMPLATES)]
    words = [w for t in lines for w in t.split()][:5000] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    data: list[tuple[str, int]] = []
    for k, family in enumerate(families[1:], 1):
        for template in TEMPLATES[family]:
            parts = template.split()
            for _ in range(60):
                own = [w for w in parts if r.random() > 0.04]
                around = [r.choice(words) for _ in range(r.choice((0, 0, 2, 5)))]
                data.append((" ".join([*around, *own] if r.random() < 0.5 else [*own, *around]), k))
    plain = [t for t in lines if not re.search(r"licen[cs]|copyright|apache|mit\b|\bcc\b|gnu|mozilla|bsd", t, re.I)]
    data += [(t, 0) for t in plain] + [(t, 0) for t in NEAR_MISSES for _ in range(20)]
    for _ in range(400):  # single words of templates among others are no licence
        data.append((" ".join(r.choice(words) if r.random() < 0.7 else r.choice(r.choice(TEMPLATES[r.choice(families[1:])]).split()) for _ in range(r.randint(4, 20))), 0))
    r.shuffle(data)
    x, y = [_line(t) for t, _ in data], np.array([k for _, k in data])
    held = np.arange(len(x)) % 5 == 0
    w, b = np.zeros((BUCKETS, len(families)), np.float32), np.zeros(len(families), np.float32)
    fit = np.flatnonzero(~held)
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for s in range(0, len(fit), 32):
            take = rng.permutation(fit)[:32] if s == 0 else fit[s : s + 32]
            p = _softmax(_scores([x[i] for i in take], w, b))
            p[np.arange(len(take)), y[take]] -= 1
            b -= rate * p.sum(axis=0) / 32
            size = np.array([len(x[i]) for i in take])
            np.add.at(w, np.concatenate([x[i] for i in take]), (-rate * np.repeat(p / np.sqrt(size + 1)[:, None], size, axis=0)).astype(np.float32))
        rng.shuffle(fit)
    z, truth = _scores([x[i] for i in np.flatnonzero(held)], w, b), y[held]
    losses = {t: -np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.2, 5, 25)}
    temperature = float(min(losses, key=losses.get))
    wrong = _softmax(z / temperature)[truth == 0][:, 1:].max(axis=1)
    return Model(families, w, b, temperature, float(min(0.9, max(FLOOR, np.quantile(wrong, 1 - PASS)))))


def fit(docs: DataFrame) -> Model:
    texts = least_by_hash(only(docs, "doc_id", "text").filter("text is not null").filter(F.octet_length("text") <= SAMPLE_BYTES), "licences", SAMPLE)
    return train([x for t in texts for x in t.split("\n") if x.strip()][:4000])


_PAIRS = {f: [(len(w), set(zip(w, w[1:], strict=False))) for t in ts for w in [_WORD.findall(t.lower())]] for f, ts in TEMPLATES.items()}
AROUND = max(n for ts in _PAIRS.values() for n, _ in ts)


def confirmed(text: str, family: str) -> tuple[int, int, int] | None:
    """Where most of a template's word pairs stand within twice its words, if they are enough: (pairs, start, end)."""
    w = list(_WORD.finditer(text))
    own = [(a.group().lower(), b.group().lower()) for a, b in zip(w, w[1:], strict=False)]
    best = None
    for n, pairs in _PAIRS[family]:
        at = [k for k, p in enumerate(own) if p in pairs]
        for a in at:
            here = [k for k in at if a <= k < a + 2 * n]
            equal = len({own[k] for k in here})
            if equal >= CONFIRM * len(pairs) and (best is None or equal > best[0]):
                best = equal, w[a].start(), w[here[-1] + 1].end()
    return best


def _settled(hits: list[tuple[int, int, int, str, float]]) -> list[tuple[str, float]]:
    """(family, score) of the hits (pairs, start, end, family, score) that overlap no hit of another family with more pairs."""
    kept: list[tuple[int, int, int, str, float]] = []
    for h in sorted(hits, key=lambda h: (-h[0], -h[4], h[3], h[1])):
        if not any(h[3] != k[3] and h[1] < k[2] and k[1] < h[2] for k in kept):
            kept.append(h)
    return [(h[3], h[4]) for h in kept]


def _units(first: np.ndarray, paragraphs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in words and in order of start, of short lines and of the windows of each paragraph.

    first: the first word of each line; paragraphs: the first word of each paragraph; both end with the number of words.
    """
    n = np.diff(first)
    short = (n > 0) & (n <= LINE)
    starts, ends = [first[:-1][short]], [first[1:][short]]
    begin, m = paragraphs[:-1], np.diff(paragraphs)
    for size in SIZES:
        step = size // 4
        count = 1 + -(-np.maximum(m - size, 0) // step)
        which = np.repeat(np.arange(len(m)), count)
        k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        s = begin[which] + np.minimum(k * step, np.maximum(m[which] - size, 0))
        starts.append(s)
        ends.append(np.minimum(s + size, begin[which] + m[which]))
    span = np.unique(np.stack([np.concatenate(starts), np.concatenate(ends)], axis=1), axis=0)
    return span[:, 0], span[:, 1]


def _likely(token: np.ndarray, start: np.ndarray, end: np.ndarray, m: Model) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, number of the family, score) of the units above the limit."""
    for low in range(0, len(token), TOKENS):
        a, b = np.searchsorted(start, [low, low + TOKENS])
        if a == b:
            continue
        s, e = start[a:b] - low, end[a:b] - low
        one, two = _grams(token[low : low + TOKENS + LINE])
        zero = np.zeros((1, len(m.families)))
        words_sum = np.concatenate([zero, np.cumsum(m.weight[one], axis=0, dtype=np.float64)])
        pairs_sum = np.concatenate([zero, np.cumsum(m.weight[two], axis=0, dtype=np.float64)])
        z = (words_sum[e] - words_sum[s] + pairs_sum[e - 1] - pairs_sum[s]) / np.sqrt(2 * (e - s))[:, None] + m.bias
        p = _softmax(z / m.temperature)
        best = p[:, 1:].argmax(axis=1) + 1
        score = p[np.arange(len(p)), best]
        for k in np.flatnonzero(score >= m.limit):
            yield int(s[k] + low), int(e[k] + low), int(best[k]), float(score[k])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: confirmed families in order of name, the number of paragraphs that hold one, and the best score (0 if none)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x families floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for first, end, data, at in chunks(batch.column(1), 1 << 19):
                breaks = np.flatnonzero(data == 10)
                lines = np.unique(np.concatenate([at, breaks, breaks + 1]))
                left, right, at_line = words(data, lines, SEPARATOR)
                token = span_hash(prefix_hash(data), left, right)
                found: dict[int, dict[int, list[tuple[str, float]]]] = {}
                if len(token):
                    # Two line feeds and more with no words between them part paragraphs.
                    feeds = np.concatenate([[0], np.cumsum(data == 10)])
                    row = np.searchsorted(at, left, "right")
                    apart = np.concatenate([[True], (np.diff(row) > 0) | (feeds[left[1:]] - feeds[right[:-1]] > 1)])
                    paragraphs = np.append(np.flatnonzero(apart), len(token))
                    for s, e, kind, score in _likely(token, *_units(at_line, paragraphs), m):
                        p = int(np.searchsorted(paragraphs, s, "right") - 1)
                        a, b = max(s - AROUND, paragraphs[p]), min(e + AROUND, paragraphs[p + 1])
                        family = m.families[kind]
                        at_byte, text = int(left[a]), data[left[a] : right[b - 1]].tobytes().decode("utf-8", "ignore")
                        if hit := confirmed(text, family):
                            bytes_to = lambda c: at_byte + len(text[:c].encode())  # noqa: B023, E731
                            found.setdefault(int(row[s] - 1), {}).setdefault(p, []).append((hit[0], bytes_to(hit[1]), bytes_to(hit[2]), family, score))
                for i in range(end - first):
                    held = found.get(i, {})
                    hits = [h for p in held.values() for h in _settled(p)]
                    out.append((sorted({f for f, _ in hits}), len(held), max((p for _, p in hits), default=0.0)))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.list_(pa.string())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["doc_id", "families", "n_paragraphs", "score"])

    texts = only(docs, "doc_id", "text").select("doc_id", F.lower("text").alias("text"))
    return texts.mapInArrow(run, FOUND)
