"""Recursive chunking of texts by separators, with an overlap, and the section that each chunk belongs to."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized

#: Separators from the strongest to the weakest, the size of chunks, and the first section of a document.
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", "。", "；", ";", ".", "，", ",", " ")
SIZE, OVERLAP = 700, 90
WHOLE = "全文"
_MARKED = re.compile(r"#{1,6}\s+(.+)")
#: Texts that are split before their chunks are handed on.
ROWS = 200


def split(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of a text. The first separator that occurs cuts it; parts are joined again while they fit, and each run of
    parts is split by the weaker separators. Without one left, windows of `size` start every size - overlap characters.
    At every level a chunk then begins with the end of the one before, and is windowed if that makes it too long."""
    if len(text) <= size:
        return [text] if text else []
    level = next((k for k, s in enumerate(separators) if s in text), None)
    if level is None:
        return _windows(text, size, overlap)
    runs = _runs(text.split(separators[level]), separators[level], size)
    chunks = [c for run in runs for c in split(run, size, overlap, separators[level + 1 :])]
    return _overlapped(chunks, size, overlap) if overlap > 0 else chunks


def _runs(parts: list[str], separator: str, size: int) -> Iterator[str]:
    """Neighbouring parts joined while they fit. A run without a character yet is replaced by the part that comes."""
    held, length = [], 0
    for part in parts:
        longer = length + len(separator) + len(part) if length else len(part)
        if length and longer > size:
            yield separator.join(held)
            held, longer = [], len(part)
        held, length = [*held, part] if length and held else [part], longer
    if length:
        yield separator.join(held)


def _windows(text: str, size: int, overlap: int) -> list[str]:
    return [text[k : k + size] for k in range(0, len(text), max(1, size - overlap))]


def _overlapped(chunks: list[str], size: int, overlap: int) -> list[str]:
    out = chunks[:1]
    for before, chunk in pairwise(chunks):
        longer = before[-overlap:] + chunk
        out += [longer] if len(longer) <= size + overlap else _windows(longer, size, overlap)
    return out


def heading(text: str) -> str | None:
    """What a chunk's first line opens: a marked heading, or a short line that ends with a colon."""
    line = text.splitlines()[0].strip() if text else ""
    if marked := _MARKED.fullmatch(line):
        return marked[1].strip() or None
    return line.rstrip("：:") or None if len(line) <= 32 and line.endswith(("：", ":")) else None


def pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, str, str | None]]:
    """(position, text, heading) of the chunks of a normalised text; empty chunks are left out, but count."""
    stripped = ((k, c.strip()) for k, c in enumerate(split(text, size, overlap)))
    return [(k, c, heading(c)) for k, c in stripped if c]


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, position, section, text); a document is split within its task, whatever its neighbours.

    Texts are normalised first. A section goes on until a chunk opens the next one. Null and empty texts have no chunk.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first in range(0, len(pdf), ROWS):
                rows = []
                for d, t in pdf.iloc[first : first + ROWS].itertuples(index=False):
                    section = WHOLE
                    for k, c, opened in pieces(t, size, overlap):
                        section = opened or section
                        rows.append((d, k, section, c))
                yield pd.DataFrame(rows, columns=["document_id", "position", "section", "text"])

    text = normalized(F.coalesce("text", F.lit("")))
    return docs.select("document_id", text.alias("text")).mapInPandas(run, "document_id long, position int, section string, text string")
