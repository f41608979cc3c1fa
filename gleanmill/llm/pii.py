"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans follow four fixed patterns. The field labels the words that hold a digit or an `@` (others are never
personal data here, so the chain falls apart at them without loss) with the four kinds or as a secret (a password,
a key): neighbouring words share a transition potential, and words of a document that are repeated or alike (equal
words of any length, the same last digits, the same value after a key, runs of neighbouring words with the same
digits) are linked by a skip potential, whatever their distance. So a bare number or value that nothing marks takes
the label of a clear mention elsewhere in the document. Loopy belief propagation gives each word's marginals; words
that no base span touches and whose label is sure enough become further spans.

The field is trained by pseudo-likelihood in numpy, on generated examples (with forms that the base patterns miss,
clear and bare mentions of one value, and look-alikes) and on a bounded sample of documents labelled by the base
patterns (SAMPLE documents of at most SAMPLE_BYTES, chosen by a hash of their id); words of the sample that no base
span touches have no known label and are left out of the likelihood.

Null texts count as empty and have no spans. Long texts are read whole, in time linear in their length but for
the digits of a span. Repeated rows and rows with a null doc_id get the answers of their texts, each its own row.
Ties between labels go to the one listed first. An empty table gives no rows. Columns besides doc_id and text are
ignored by `detect`; `redact` keeps them all.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_by_hash, only

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS, "secret")
SAMPLE = 300
SAMPLE_BYTES = 20_000
#: Marginal from which a word is personal data, and rounds of message passing.
SURE = 0.9
ROUNDS, DAMPING = 8, 0.3
#: Documents of a batch whose words are inferred together.
TOGETHER = 256

FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long"

_ANY = re.compile("[0-9@]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by kind and start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL_END.match(text[start - 1]):
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, end := m.end()))
        free = end
        at = text.find("@", end)
    for m in _QUADS.finditer(text):
        parts, here = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            size = len(".".join(parts[k : k + 4]))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[k : k + 4]):
                out.append(("ip", here, here + size))
            here += size + 1
    for m in _DIGITS.finditer(text):
        digits = re.sub("[ -]", "", m.group()) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """The words with a digit or an `@`."""
    out, last = [], -1
    for m in _ANY.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        while start > max(last, 0) and not text[start - 1].isspace():
            start -= 1
        end, n = m.end(), len(text)
        while end < n and not text[end].isspace():
            end += 1
        out.append((start, end))
        last = end
    return out


_SHAPES = [
    re.compile(p)
    for p in (
        r"[(<\[\"']*[^@\s]+@[^@\s]+\.[A-Za-z]{2,}[)>\]\"'.,;:!?]*",
        r"[(<\[\"']*\d{1,3}(\.\d{1,3}){3}(:\d+)?[)>\]\"'.,;:!?]*",
        r"\+\d.*",
        r"\(\d{2,4}\)",
        r"\d{3}[-.]\d{4}[.,;:!?]*",
        r"\(?\d{3}\)?[-.]\d{3}[-.]\d{4}[.,;:!?]*",
        r"\d{4}[.,;:!?]*",
        r"\d{4}-\d{4}-\d{4}-\d{4}[.,;:!?]*",
        r"\d{13,19}[.,;:!?]*",
        r"\d{4}-\d{2}-\d{2}.*",
        r"\d{1,2}:\d{2}.*",
        r"[vV]?\d{1,3}(\.\d+){0,2}[.,;:!?]*",
        r".*[A-Za-z].*",
        r".*=.*",
        r"[\"'#$].*",
        r"\d{1,3}(,\d{3})+(\.\d+)?[.,;:!?]*",
    )
]


_KEYED = re.compile(r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|key)\W{0,3}[=:]\W{0,3}")
_VALUE = re.compile(r"[(<\[\"']*[A-Za-z0-9+/_-]{16,}[)>\]\"'.,;:!?#$%&*]*")


def features(word: str, digits_in_run: int, before: str) -> list[int]:
    """Numbers of the features that a word has; before: what stands before it."""
    digits = sum("0" <= c <= "9" for c in word)
    out = [0, 1 + min(digits, 20), 22 + min(word.count("."), 5), 28 + min(digits_in_run, 20)]
    out += [50 + k for k, p in enumerate(_SHAPES) if len(word) < 200 and p.fullmatch(word)]
    more = 50 + len(_SHAPES)
    if 13 <= digits <= 19:
        out.append(more + luhn(_digits(word)))
    if "@" in word:
        out.append(more + 2)
    if (m := _KEYED.search(before)) and m.end() == len(before):
        out.append(more + 3)
    if _KEYED.match(word):
        out.append(more + 4)
    if len(word) < 200 and _VALUE.fullmatch(word):
        out += [more + 5 + (not word.strip("()<>[]\"'.,;:!?#$%&*").isdigit())]
    return out


N_FEATURES = 57 + len(_SHAPES)


def alike(word: str, run: str) -> list[str]:
    """Keys of a word in a run of neighbouring words with these digits; words that share a key are linked, whatever their distance."""
    digits = _digits(word)
    bare = word.strip(_MARKS).lower()
    keys = ["=" + bare] if bare else []
    if (m := _KEYED.match(word)) and (value := word[m.end() :].strip(_MARKS).lower()):
        keys.append("=" + value)
    if len(digits) >= 7:
        keys.append("7" + digits[-7:])
    if len(run) >= 7 and digits:
        keys.append("r" + run)
    return keys


_MARKS = "()<>[]\"'.,;:!?#$%&*"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


@dataclass
class Graph:
    """The words of many documents, their features, and links (chain: in order; skip: alike)."""

    where: list[tuple[int, int, int]]
    feats: list[list[int]]
    chain: np.ndarray
    skip: np.ndarray


def graph(texts: list[str]) -> Graph:
    where, feats, chain, skip = [], [], [], []
    for doc, text in enumerate(texts):
        found = tokens(text)
        runs: list[list[tuple[int, int]]] = []
        for t in found:
            if runs and not text[runs[-1][-1][1] : t[0]].strip() and t[0] - runs[-1][-1][1] <= 2 and "\n" not in text[runs[-1][-1][1] : t[0]]:
                runs[-1].append(t)
            else:
                runs.append([t])
        last: dict[str, int] = {}
        fresh: dict[str, int] = {}
        for run in runs:
            digits = "".join(_digits(text[s:e]) for s, e in run)
            began = len(where)
            for k, (s, e) in enumerate(run):
                here = len(where)
                word = text[s:e]
                where.append((doc, s, e))
                feats.append(features(word, len(digits), text[max(0, s - 24) : s].rsplit("\n", 1)[-1]))
                if k:
                    chain.append((here - 1, here))
                keys = alike(word, digits)
                # Words of one run are neighbours already: a link leads to the last like word of an earlier run.
                skip += [(o, here) for o in sorted({last[key] for key in keys if key in last}) if o < began]
                for key in keys:
                    fresh[key] = here
            last.update(fresh)
            fresh.clear()
    empty = np.zeros((0, 2), np.int64)
    return Graph(where, feats, np.array(chain) if chain else empty, np.array(skip) if skip else empty)


@dataclass
class Field:
    emit: np.ndarray
    step: np.ndarray
    skip: float


def _unary(g: Graph, emit: np.ndarray) -> np.ndarray:
    size = np.array([len(f) for f in g.feats])
    return np.add.reduceat(emit[np.concatenate(g.feats)], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[list[Span]], partly: int = 0, epochs: int = 1000, rate: float = 1.0) -> Field:
    """Pseudo-likelihood: each word's label given its features and its neighbours' labels. Of the last `partly` texts only the labelled words count."""
    g, n = graph(texts), len(LABELS)
    y = np.zeros(len(g.where), np.int64)
    for k, (doc, s, e) in enumerate(g.where):
        y[k] = next((LABELS.index(kind) for kind, a, b in labels[doc] if a < e and s < b), 0)
    x = np.zeros((len(y), N_FEATURES), np.float32)
    for k, f in enumerate(g.feats):
        x[k, f] = 1
    emit, step, skip = np.zeros((N_FEATURES, n)), np.zeros((n, n)), 0.5
    near = np.zeros((len(y), n))
    np.add.at(near, (g.skip[:, 0], y[g.skip[:, 1]]), 1)
    np.add.at(near, (g.skip[:, 1], y[g.skip[:, 0]]), 1)
    a, b = g.chain[:, 0], g.chain[:, 1]
    truth = np.eye(n)[y]
    unknown = np.array([doc >= len(texts) - partly for doc, _, _ in g.where]) & (y == 0)
    weight = np.where(unknown, 0.0, np.where(y == 0, 1.0, 2.0))[:, None] / len(y)
    for _ in range(epochs):
        z = x @ emit + skip * near
        np.add.at(z, b, step[y[a]])
        np.add.at(z, a, step[:, y[b]].T)
        d = (truth - _softmax(z)) * weight * 10
        emit += rate * (x.T @ d - 1e-4 * emit)
        grad = np.zeros((n, n))
        np.add.at(grad, y[a], d[b])
        grad_t = np.zeros((n, n))
        np.add.at(grad_t, y[b], d[a])
        step += rate * (grad + grad_t.T - 1e-4 * step)
        skip = max(0.0, skip + rate * float((d * near).sum()))
    return Field(emit, step, skip)


def marginals(g: Graph, field: Field) -> np.ndarray:
    """Loopy belief propagation over all links at once."""
    unary = _unary(g, field.emit)
    n = len(LABELS)
    source = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
    target = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
    c, s = len(g.chain), len(g.skip)
    back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
    pot = np.concatenate([np.broadcast_to(field.step, (c, n, n)), np.broadcast_to(field.step.T, (c, n, n)), np.broadcast_to(field.skip * np.eye(n), (2 * s, n, n))])
    message = np.zeros((len(source), n))
    belief = unary
    for _ in range(ROUNDS if len(source) else 0):
        z = (belief[source] - message[back])[:, :, None] + pot
        top = z.max(axis=1, keepdims=True)
        new = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0, :]
        new -= new.max(axis=1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, target, message)
    return _softmax(belief)


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """What the field finds outside of the base spans; neighbouring words with one label become one span."""
    out: list[list[Span]] = [[] for _ in texts]
    g = graph(texts)
    if not g.where:
        return out
    p = marginals(g, field)
    best, sure = p.argmax(axis=1), p.max(axis=1) >= SURE
    joined = {int(b) for _, b in g.chain}
    last = None
    for k, (doc, s, e) in enumerate(g.where):
        kind = LABELS[best[k]]
        if kind == "o" or not sure[k] or any(a < e and s < b for _, a, b in base[doc]):
            last = None
            continue
        if last == kind and k in joined:
            kept = out[doc].pop()
            out[doc].append((kind, kept[1], e))
        else:
            out[doc].append((kind, s, e))
        last = kind
    return [[t for t in (_trimmed(text, x) for x in spans) if _plausible(text, t)] for text, spans in zip(texts, out, strict=True)]


def _trimmed(text: str, span: Span) -> Span:
    kind, s, e = span
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while s < e and not text[e - 1].isalnum():
        e -= 1
    return kind, s, e


def _plausible(text: str, span: Span) -> bool:
    kind, s, e = span
    digits = len(_digits(text[s:e]))
    return s < e and {"email": "@" in text[s:e], "ip": digits >= 4, "card": 13 <= digits <= 19 and luhn("".join(c for c in text[s:e] if "0" <= c <= "9")), "phone": 7 <= digits <= 15, "secret": e - s >= 8}[kind]


def examples(seed: int = 5, n: int = 1500) -> tuple[list[str], list[list[Span]]]:
    """Generated documents with labelled spans: usual and unusual forms, repeated mentions, and numbers that are no personal data."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=2, b=9: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(a, b)))

    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def card(sep: str) -> str:
        d = r.choice("3456") + digit(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    def no_card() -> str:
        d = digit(15)
        return d + next(c for c in "3141592" if not luhn(d + c))

    def plain(kind: str, form: str) -> str:
        """The same value without what marks it."""
        if kind == "phone":
            return _digits(form)[-10:]
        if kind == "card":
            return r.choice(("", "-")).join(_digits(form)[k : k + 4] for k in range(0, 16, 4))
        if kind == "secret":
            return re.split(r"[=: ]+", form)[-1].strip('"')
        return form

    keys = ("token", "password", "secret", "api_key", "access_key", "pwd")
    makers = {
        "email": [lambda: f"{word()}.{digit(2)}@{word()}.{word(2, 3)}", lambda: f"{word()}_{word()}@{word()}.{word()}.com", lambda: f"{word()}é@{word()}.org"],
        "ip": [lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)) + f":{r.randint(80, 9999)}"],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("-")],
        "phone": [lambda: f"+{r.randint(1, 99)} ({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"{digit(3)}-{digit(3)}-{digit(4)}", lambda: f"+{r.randint(1, 99)} {digit(3)} {digit(3)} {digit(4)}"],
        "secret": [lambda: f'{r.choice(keys)} = "{hexa(r.choice((32, 40)))}"', lambda: f"{r.choice(keys)}={word()}{digit(4)}{word()}{digit(4)}", lambda: f"{r.choice(keys)}: {hexa(24)}"],
    }
    other = [
        lambda: str(r.randint(1900, 2035)), lambda: f"{r.randint(1, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(0, 23)}:{digit(2)}", lambda: f"20{digit(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: hexa(r.choice((24, 32, 40))), lambda: digit(10), no_card, lambda: f"{r.randint(1, 99)},{digit(3)}", lambda: digit(r.randint(1, 6)), lambda: f"{r.randint(1, 99)})", lambda: f"#{digit(4)}",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{word()}{digit(2)}", lambda: digit(r.randint(20, 30)), lambda: "9" + digit(r.choice((8, 10, 11))), lambda: f"@{word()}", lambda: f"{r.randint(1, 9)}.{digit(6)}", lambda: f"{word()}{digit(4)}{word()}{digit(4)}",
    ]
    texts, labels = [], []
    for _ in range(n):
        text, spans = "", []
        seen: list[tuple[str, str]] = []
        shown: list[str] = []
        for _ in range(r.randint(2, 8)):
            if r.random() < 0.8:  # else two values stand side by side
                text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.5:
                if seen and r.random() < 0.5:
                    kind, form = r.choice(seen)
                    form = plain(kind, form) if r.random() < 0.7 else form
                else:
                    kind = r.choice(tuple(makers))
                    form = r.choice(makers[kind])()
                    seen.append((kind, form))
                spans.append((kind, len(text), len(text) + len(form)))
                text += form
            else:
                shown.append(r.choice(shown) if shown and r.random() < 0.3 else r.choice(other)())
                text += shown[-1]
            text += r.choice((" ", ". ", ", ", " "))
        texts.append(text)
        labels.append(spans)
    return texts, labels


def fit(docs: DataFrame) -> Field:
    texts, labels = examples()
    more = least_by_hash(only(docs, "doc_id", "text").filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= SAMPLE_BYTES)), "pii", SAMPLE)
    return train(texts + more, labels + [base_spans(t) for t in more], partly=len(more))


def find(texts: list[str | None], field: Field) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base, added) of each text, in order."""
    for k in range(0, len(texts), TOGETHER):
        part = [t or "" for t in texts[k : k + TOGETHER]]
        some = [i for i, t in enumerate(part) if _ANY.search(t)]
        base = {i: base_spans(part[i]) for i in some}
        added = dict(zip(some, added_spans([part[i] for i in some], [base[i] for i in some], field), strict=True))
        for i in range(len(part)):
            yield base.get(i, []), added.get(i, [])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (LABELS.index(x[0]), x[1], x[2])))


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """A row per document: counts of base spans by kind, their digest, and all spans as kind:start:end in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, added in find(batch.column(1).to_pylist(), shared.value):
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(base) + len(added), len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"])

    return only(docs, "doc_id", "text").mapInArrow(run, FOUND)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each maximal run of overlapping spans replaced by the name of its first kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The documents (all columns) with personal data masked in text; n_chars, where there is one, follows."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        texts = [None if t is None or t is pd.NA or t != t else t for t in text]
        return pd.Series([masked(t, b + a) for t, (b, a) in zip(texts, find(texts, shared.value), strict=True)], dtype=object)

    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
