"""Repeated n-grams against brute force, and keyword scores that normalise a text once for all terms."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gleanmill.operators import curation as C


def test_repeated_ngram_against_plain(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(["ab", "abc", "the ", "x", "点赞"]) for _ in range(r.randint(0, 40))) for _ in range(150)]
    texts += [("abcdefghijkl" * c) + "".join(chr(0x4E00 + k) for k in range(rest)) for c in (2, 3, 4) for rest in (0, 12, 23, 24, 25, 32, 33)]

    def plain(t):
        k = re.sub(C.NOISE_MARKS, "", t)
        grams = lambda w: [k[i : i + w] for i in range(len(k) - w + 1)]
        return len(k) >= 18 and any(len(k) >= 3 * w and any(c >= 3 and c * w * 100 >= len(k) * 60 for c in map(grams(w).count, set(grams(w)))) for w in C.NOISE_WIDTHS)

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(C.repeated_ngram(F.col("t"))).collect()
    assert [x[0] for x in rows] == [plain(t) for t in texts] and 10 < sum(map(plain, texts)) < len(texts)


def test_keyword_hits_normalises_once(spark):
    pieces = spark.createDataFrame([(1, n, f"word{n} log") for n in range(5)], "key long, n long, text string")
    terms = spark.createDataFrame([(1, "log"), (1, "word3")], "key long, term string")
    hits = C.keyword_hits(pieces, terms, "key", "n", "text", 1)
    assert sorted(r["n"] for r in hits.collect()) == [2, 3, 4]
    body = [line for line in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "aggregate(" in line and "Project" in line]
    assert body and all(line.count(r"[\W_]+") == 1 for line in body)
