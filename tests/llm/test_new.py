"""Source divergence, embedding whitening and byte-level BPE against SQL, brute force and the tokenizers library."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from compare import rows
from conftest import SF
from pyspark.sql import functions as F

from gleanmill.llm import bpe, divergence, queries, whitening

TEXTS = "doc_id long, text string, lang string, source string, term string, n long, p long, block long"


def as_docs(spark, data):
    return spark.createDataFrame([(*d, "x", 1, 2, 3) for d in data], TEXTS)


def sql_over(duck, df, table, name):
    con = duck.cursor()
    con.register("given", df.toPandas())
    con.execute(f"create or replace temp view {table} as select * from given")
    return con.execute(queries.ORACLE_SQL[name]).df()


def test_divergence_sql(spark, duck):
    got = queries.QUERIES["op11_source_divergence"](spark, SF).toPandas()
    want = duck.execute(queries.ORACLE_SQL["op11_source_divergence"]).df()
    assert rows(got) == rows(want) and len(got) and set(got.part) == {"pair", "term"}


@pytest.fixture(scope="module")
def odd_docs(spark):
    r = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉTÉ", "été", "日本語", "x", "don't", "tab\x00nul", "e-mail", "𝒳y"]
    data = [(k % 7 or None, " ".join(r.choices(words, k=r.randrange(30))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", None, "Z", "é"])) for k in range(120)]
    data += [(1, None, "en", "only null"), (1, "", "fr", "empty"), (2, "rare words of one text", "fr", "b"), (3, "long " * 60_000 + "Alpha", "en", "a"), (3, "long " * 60_000 + "Alpha", "en", "a")]
    return as_docs(spark, data)


@pytest.mark.parametrize("block", [divergence.BLOCK_TERMS, 3])
def test_divergence_odd_tables(spark, duck, odd_docs, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    for docs in (odd_docs, odd_docs.filter("false"), odd_docs.filter("lang = 'fr'")):
        got = divergence.audit(docs).toPandas()
        assert rows(got) == rows(sql_over(duck, docs, "documents", "op11_source_divergence"))


def test_divergence_by_hand(spark):
    docs = as_docs(spark, [(k, "one two two", "en", "s") for k in range(10)] + [(k, "one", "en", "t") for k in range(10)] + [(1, "two", "en", "u")])
    found = {(r.source, r.part, r["item"]): (r.value, r.rank) for r in divergence.audit(docs).collect()}
    share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 4)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    s, t, u, lang = [share(10, 30), share(20, 30)], [share(10, 10), share(0, 10)], [share(0, 1), share(1, 1)], [share(20, 41), share(21, 41)]
    assert found["s", "pair", "t"][0] == f(s[0], t[0]) + f(s[1], t[1]) == found["t", "pair", "s"][0]
    assert found["s", "pair", "u"] == (f(s[0], u[0]) + f(s[1], u[1]), 2)
    assert found["s", "term", "two"] == (f(s[1], lang[1]), 1) and ("s", "term", "one") not in found
    assert found["t", "term", "one"] == (f(t[0], lang[0]), 1)


def test_divergence_share_is_exact(spark):
    cases = [(0, 0, 0 + 1), (10**13, 3 * 10**13, 10**6), (7, 10**9, 123_457), (10**9 - 1, 10**9, 1)]
    df = spark.createDataFrame(cases, "n long, total long, v long").select("n", "total", "v", divergence.share("n", "total", "v").alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 2) // (r.total + 2 * r.v) for r in df.collect())


def vectors(spark, data):
    return spark.createDataFrame([(*d, "x", 5) for d in data], "vec_id long, embedding array<float>, component string, n int").repartition(5)


def brute(data, d):
    """Rows of (vec_id, x) with numpy's own solver."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in data if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], np.int64)
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    return kept, n, deviation, centred, values[::-1], axes[:, ::-1]


def test_whitening_brute_force(spark):
    r = np.random.default_rng(3)
    data = [(k // 2 if k % 5 else None, [float(c) for c in v]) for k, v in enumerate(r.normal(size=(90, 12)) * np.linspace(0.02, 0.5, 12) + r.normal(size=12))]
    odd = [(1, None), (2, []), (3, [None] * 12), (4, [float("nan")] * 12), (5, [0.1] * 11 + [float("inf")]), (6, [0.5] * 11), (7, [1e30] * 12)]
    table = vectors(spark, data + data[:3] + odd)
    got = whitening.whiten(table, whitening.fit(table)).collect()
    kept, n, deviation, centred, values, axes = brute(data + data[:3], 12)
    assert len(got) == 8 * n == 8 * 93
    for k in range(8):
        want = sorted(zip(deviation, (centred @ axes[:, k] / np.sqrt(values[k])), strict=True))
        of = sorted((x.deviation, x.whitened) for x in got if x.component == k + 1)
        assert [a for a, _ in of] == [a for a, _ in want]
        assert any(np.allclose([b for _, b in of], [sign * b for _, b in want], rtol=1e-8, atol=1e-9) for sign in (1, -1))
        assert [*{x.explained for x in got if x.component == k + 1}] == [pytest.approx(values[k] / values.sum(), rel=1e-9)]
    assert {x.n for x in got} == {n} and len({x.identity_error for x in got}) == 1 and got[0].identity_error < 1e-9
    assert sorted(str(x.vec_id) for x in got if x.component == 1) == sorted(str(i) for i, _ in kept)


def test_whitening_of_tables_without_variance(spark):
    none = vectors(spark, [(1, [0.5, 0.25])]).filter("false")
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    assert whitening.fit(vectors(spark, [(1, None), (2, [])])) is None
    same = vectors(spark, [(k, [0.5, 0.25]) for k in range(4)])
    got = whitening.whiten(same, whitening.fit(same)).collect()
    assert len(got) == 8 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in got)
    flat = vectors(spark, [(k, [k / 8, 0.25, -k / 4]) for k in range(6)])
    got = whitening.whiten(flat, whitening.fit(flat)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9


def test_moments_merge_alike_however_dealt(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = whitening.fit(table.coalesce(1)), whitening.fit(table.repartition(300, F.rand(1)))
    assert one.n == many.n and one.sums == many.sums
    assert np.allclose(one.values, many.values, rtol=1e-10) and np.allclose(np.abs(one.components @ many.components.T), np.eye(8), atol=1e-6)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_symmetric_qr(d):
    r = np.random.default_rng(d)
    for a in (r.normal(size=(d, d)), np.zeros((d, d)), np.ones((d, d)), np.diag(np.arange(d) * 1e6 + 1)):
        a = (a + a.T) / 2
        values, axes = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-9 * (1 + abs(a).max()))
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12) and np.allclose(axes * values @ axes.T, a, atol=1e-9 * (1 + abs(a).max()))


def test_deviation_is_exact_or_fails():
    model = whitening.Whitening(10**6, [3 * 10**9, 5], np.eye(2), np.ones(2), 2.0)
    x = np.array([[4000, 2]], np.int64)
    assert whitening._deviation(x, model)[0] == (10**6 * 4000 - 3 * 10**9) ** 2 + (2 * 10**6 - 5) ** 2
    with pytest.raises(OverflowError):
        whitening._deviation(x * 1000, model)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def hard_texts():
    r = random.Random(8)
    latin = [chr(c) for c in range(0x20, 0x250)] + list("\t\n\r‐—“”…‰⁞€")
    wide = latin + list("日本語العربيةहिन्दी한국어ёж🙂👩‍👩‍👧́ 　\u0085\x1c\x0b٣²Ⅷ𝒳")
    out = [None, "", " ", "\n\n \n", "a", "don't we'll I'VE 'twas", "  two  spaces ", "x" * 5000, " " * 3000 + "end", "=" * 700, "ab" * 2000, "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext", "tail \n", "\xa0 \xa0x", "1234567890" * 40, "nul\x00nul"]
    out += ["".join(r.choices(latin, k=r.randrange(1, 200))) for _ in range(150)] + ["".join(r.choices(wide, k=r.randrange(1, 200))) for _ in range(150)]
    return out + ["".join(r.choices("abc de\n", k=r.randrange(1, 300))) for _ in range(150)] + ["".join(r.choices("etaoin shr", k=r.randrange(1, 300))) for _ in range(150)]


def test_bpe_is_the_tokenizers(spark, library):
    texts = hard_texts()
    df = spark.createDataFrame([(k if k % 9 else None, t, [1], "x") for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded string").repartition(3)
    got = bpe.decode(bpe.encode(df)).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(df.filter("false"))).count() == 0


def test_bpe_on_documents(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op13_bpe_round_trip"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_decodes_any_ids(spark, library):
    r = random.Random(2)
    ids = [[r.randrange(50257) for _ in range(r.randrange(40))] for _ in range(200)]
    got = bpe.decode(spark.createDataFrame([(k, v) for k, v in enumerate([*ids, None])], "k int, ids array<int>")).collect()
    assert [x.decoded for x in sorted(got, key=lambda x: x.k)] == [library.decode(v, skip_special_tokens=False) for v in ids] + [""]


def test_shared_prefixes_are_computed_once(monkeypatch):
    coder, seen = bpe.Coder(bpe.default_path()), []
    last = bpe.Coder._last
    monkeypatch.setattr(bpe.Coder, "_last", lambda self, word, so_far, depth: (seen.append(word[:depth]), last(self, word, so_far, depth))[1])
    coder.learn({b"internation", b"international", b"internet", b"inter"})
    assert len(seen) == len(set(seen)) == len("international") + len("et")


def test_caches_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MOST_WORDS", 50)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 20)
    coder = bpe.Coder(bpe.default_path())
    for t in hard_texts()[20:120]:
        data = t.encode()
        assert coder.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] == np.array(library.encode(t, add_special_tokens=False).ids, np.int32).tobytes()
        assert len(coder.pairs) <= 20
