"""Byte-level BPE encoding and decoding by a trie over the distinct words of a batch.

What makes it work: the encoding of a word's first i bytes is that of its first i - k bytes and one more token of k
bytes, and a run of tokens is an encoding just if each neighbouring pair of them is what the merges make of the pair's
own bytes. So one token, the last one, says all about a prefix. The distinct words of a batch that are not known yet are
inserted into a trie; going down depth first, a node's last token is the one token that ends there and goes with the last
token of the node where it begins, and prefixes that words share are computed once. A word's ids are read off backwards.

One map over the documents; ids of words and the verdicts on pairs are kept in each worker, in caches of bounded size.
Words are cut as the vocabulary's file says: texts of Latin characters and common punctuation all at once, by the kinds
of neighbouring characters, others by the tokenizer's own splitter. Each distinct word of a chunk is looked up once, and
Arrow puts the ids, or the bytes of tokens, one after another. A special token's string in a text is that token, as in
the tokenizers library.

Null texts count as empty; empty texts have no ids and decode to the empty text. Long texts and long words are read
whole. Rows are judged one by one: ties do not arise, repeated rows and null ids change nothing. encode and decode keep
all columns (one named like a new one is replaced), and empty tables stay empty.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, chunks
from .tokens import _byte_of

#: Words whose ids, and pairs whose verdict, a worker keeps; caches only, emptied when full.
MOST_WORDS, MOST_PAIRS = 120_000, 500_000
#: Bytes of text whose words go into one trie.
TRIE_BYTES = 1 << 20
#: Rows whose tokens are put together at once.
DECODED = 100

#: Kinds of characters; beyond those of the table the tokenizer's own splitter is asked.
_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)


def _kinds() -> np.ndarray:
    """The kind of each code point below 0x3000. The pattern's classes, told for Latin letters and common punctuation."""
    out = np.full(0x3000, _UNKNOWN, np.uint8)
    out[0x20:0x7F] = out[0xA0:0xC0] = out[0x2010:0x2028] = out[0x2030:0x205F] = out[0x20AC] = _OTHER
    out[0xC0:0x250] = _LETTER
    out[[0xD7, 0xF7]] = _OTHER
    for kind, chars in ((_LETTER, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzªµº"), (_DIGIT, "0123456789²³¹¼½¾"), (_SPACE, "\t\n\r \xa0")):
        out[[ord(c) for c in chars]] = kind
    return out


_KIND = _kinds()
#: What an apostrophe takes along.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")


def word_starts(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in texts that lie one after another (first: where each text does), and the kinds of all characters.

    A word is a run of one kind. A space before a run that is no white space goes with it, any other last character of
    white space stands alone; an apostrophe at the start of a word goes with s, t, m, d, re, ve or ll behind it.
    """
    kind = _KIND[np.minimum(points, len(_KIND) - 1)]
    n = len(kind)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    text = begins.copy()
    text[n] = True
    begins[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(begins[1:n] & ~text[1:n] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    begins[after - 1] = True
    begins[after] = points[after - 1] != 0x20
    for k in np.flatnonzero((points == 0x27) & begins[:n]):
        tail = "" if text[k + 1] else "".join(map(chr, points[k + 1 : k + 2 if k + 2 > n or text[k + 2] else k + 3].tolist()))
        if size := 2 if tail[:1] in SHORT else 3 if tail in LONG else 0:
            begins[k + 1 : k + size] = False
            begins[k + size] = True
    return begins[:n], kind


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Coder:
    """ids(words) for sets of words, split(text), and bytes of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        byte_of = _byte_of()
        raw = lambda token: bytes(byte_of[c] for c in token)
        vocabulary, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]) or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without normaliser and prefix space")
        self.special = special
        self.marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.bytes_of = {k: raw(t) for t, k in vocabulary.items() if t not in special} | {k: t.encode() for t, k in special.items()}
        self.single = {b: vocabulary[t] for t in byte_of if len(b := raw(t)) == 1 and t in vocabulary}
        self.merge = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.down, self.token_at = {}, [-1]  # a trie over reversed tokens: what can end at a byte, found backwards
        for k, token in self.bytes_of.items():
            node = 0
            for b in reversed(token) if k not in special.values() else b"":
                if (below := self.down.get(node << 8 | b)) is None:
                    below = self.down[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                node = below
            if node:
                self.token_at[node] = k
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.table = pa.array([self.bytes_of.get(k, b"") for k in range(max(self.bytes_of) + 1)], pa.binary())

    def merged(self, data: bytes) -> list[int]:
        """The merges applied to some bytes, the least rank first and of equal ranks the leftmost: the rule that decides on tokens and pairs."""
        ids = [self.single[bytes((b,))] for b in data]
        while len(ids) > 1:
            rank, k, new = min(((*self.merge[p][:1], k, self.merge[p][1]) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=(None, 0, 0))
            if rank is None:
                break
            ids[k : k + 2] = [new]
        return ids

    def fits(self, last: int, token: int) -> bool:
        """Whether token can follow last (-1: the word's beginning) in an encoding."""
        if (out := self.pairs.get((last, token))) is None:
            out = self.merged(self.bytes_of[token]) == [token] if last < 0 else self.fits(-1, token) and self.merged(self.bytes_of[last] + self.bytes_of[token]) == [last, token]
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[last, token] = out
        return out

    def learn(self, words: set[bytes]) -> None:
        """Encodes new words through one trie, kept flat: words in sorted order are met as going down depth first meets them.

        last[i] is the last token of the current word's first i bytes; what the next word shares with it stays.
        """
        last, before = [-1], b""
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            for depth in range(same + 1, len(word) + 1):
                last.append(self._last(word, last, depth))
            self.known[word] = self._read(last)
            before = word

    def _last(self, word: bytes, last: list[int], depth: int) -> int:
        """The token that ends a prefix: of those that end here, the one that goes with the token before it."""
        node, ending = 0, []
        for k in range(depth - 1, -1, -1):
            if (node := self.down.get(node << 8 | word[k])) is None:
                break
            if (token := self.token_at[node]) >= 0:
                ending.append((last[k], token))
        for pair in reversed(ending):
            if (fit := self.pairs.get(pair)) is None:
                fit = self.fits(*pair)
            if fit:
                return pair[1]
        raise ValueError("no token ends here; the vocabulary lacks a byte")

    def _read(self, last: list[int]) -> bytes:
        ids, at = array("i"), len(last) - 1
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        ids.reverse()
        return ids.tobytes()

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit numbers. A full cache becomes the older one, whose words come back as they are met."""
        if len(self.known) >= MOST_WORDS:
            self.older, self.known = self.known, {}
        for w in words:
            if w not in self.known and w in self.older:
                self.known[w] = self.older[w]
        self.learn({w for w in words if w not in self.known})
        return [self.known[w] for w in words]

    def _one(self, text: str) -> bytes:
        """A text with other characters or special tokens, split by the tokenizer between them."""
        at, out = 0, []
        for start, end, mark in [*((m.start(), m.end(), m[0]) for m in (self.marks.finditer(text) if self.marks else ())), (len(text), len(text), None)]:
            part = text[at:start]
            out += self.ids([part[a:b].encode() for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(part)])
            out += [array("i", [self.special[mark]]).tobytes()] if mark else []
            at = end
        return b"".join(out)

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of texts that lie one after another in UTF-8 (at: where each starts, and the end)."""
        whole = data.tobytes()
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(byte_at, at)
        begins, kind = word_starts(points, first[:-1][first[:-1] < first[1:]])
        odd = set(np.searchsorted(first, np.flatnonzero(kind == _UNKNOWN), side="right") - 1)
        odd |= {int(np.searchsorted(at, m.start(), side="right")) - 1 for mark in self.special for m in re.finditer(re.escape(mark.encode()), whole)}
        start = np.flatnonzero(begins)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(byte_at[start], len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self.ids(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        _, offsets, found = ids.buffers()
        ends = np.frombuffer(offsets, np.int32)[: len(start) + 1][np.searchsorted(start, first)]
        found = found.to_pybytes() if found is not None else b""
        return [self._one(whole[at[k] : at[k + 1]].decode()) if k in odd else found[ends[k] : ends[k + 1]] for k in range(len(at) - 1)]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _with(df: DataFrame, source: str, name: str, kind: str, make) -> DataFrame:
    """df and a column made of another one, batch by batch; rows and columns stay as they are."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != name]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for made in make(batch.column(n)):
                part = batch.slice(first, len(made))
                first += len(made)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], made], names=[*kept, name])

    columns = df.select(*[f"`{c}`" for c in kept])
    return df.select(*[f"`{c}`" for c in kept], df[f"`{source}`"].alias("__input")).mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema] + [f"{name} {kind}"]))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids array<int> of text."""
    path = path or default_path()

    def make(column: pa.Array) -> Iterator[pa.Array]:
        for _, _, data, at in chunks(column, TRIE_BYTES):
            ids = coder(path).encode(data, at)
            offsets = [0]
            for x in ids:
                offsets.append(offsets[-1] + len(x) // 4)
            data = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), data)

    return _with(docs, "text", "ids", "array<int>", make)


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with decoded, the text of ids; bytes that are no UTF-8 become replacement characters. Null ids: the empty text."""
    path = path or default_path()

    def make(column: pa.Array) -> Iterator[pa.Array]:
        table, column = coder(path).table, column.fill_null([]) if column.null_count else column
        for k in range(0, len(column), DECODED):
            lists = column.slice(k, DECODED)
            at = lists.offsets.to_numpy()
            tokens = table.take(lists.values.slice(at[0], at[-1] - at[0]))
            _, offsets, data = tokens.buffers()
            ends = np.frombuffer(offsets, np.int32)[tokens.offset :][at - at[0]]
            data = data.to_pybytes() if data is not None else b""
            yield pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())

    return _with(docs, "ids", "decoded", "string", make)
