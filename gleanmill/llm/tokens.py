"""Token ids of the public word-end BPE, as bytes, with a cache of words inside each worker.

The vocabulary has a mark for the end of a word, which never spans white space, so a text's ids are those of its
words in order. Words are encoded once and kept; byte-pair merging of new words runs in tiktoken over the same
vocabulary and ranks. Texts with characters outside a set for which this is known to be the same (Latin-1
without its superscript digits and fractions, and common punctuation), and texts that spell a special token, go to
the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Words kept by a worker; a cache only, emptied when full.
MOST_WORDS = 400_000
END = b"\xff"

_OTHER = re.compile("[^\t\n\r -~ -¨ª-¬®-±´-¸º»¿-ÿ–—‘’“”…€]")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids, special tokens not added."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        byte_of, ranks = _byte_of(), {}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        for token, k in vocabulary.items():
            if not token.startswith("<|"):
                ends = token.endswith("</w>")
                ranks[bytes(byte_of[c] for c in (token[:-4] if ends else token)) + END * ends] = k
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (out := self.known.get(piece)) is None:
            out = self._keep(piece, array("I", self.merge(piece.encode() + END)).tobytes())
        return out

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self.known) >= MOST_WORDS:
            self.known.clear()
        self.known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text or _OTHER.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.lower().split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            if (x := known.get(w)) is None:
                x = self._piece(w) if w.isalpha() else self._keep(w, b"".join([self._piece(p) for p in _PIECE.findall(w)]))
            out.append(x)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
