"""The chunker against hand-worked chunks and a plain version of its rule over the whole table."""

from __future__ import annotations

import random
import re

import pytest
from conftest import SF

from gleanmill.operators import chunking, index
from gleanmill.plans.catalog import QUERIES


def plain(text, size, overlap, seps):
    """The rule on strings, step by step."""
    if not text:
        return []
    if len(text) <= size:
        return [text]
    if not seps:
        out = []
        for k in range(len(text)):
            if k % max(1, size - overlap) == 0:
                out.append(text[k : k + size])
        return out
    if seps[0] not in text:
        return plain(text, size, overlap, seps[1:])
    runs, now = [], ""
    for part in text.split(seps[0]):
        longer = f"{now}{seps[0]}{part}" if now else part
        if len(longer) > size:
            runs, now = runs + [now], part
        else:
            now = longer
    level = sum((plain(r, size, overlap, seps[1:]) for r in [*runs, now] if r), [])
    if overlap < 1:
        return level
    out = []
    for k, c in enumerate(level):
        full = level[k - 1][-overlap:] + c if k else c
        out += plain(full, size, overlap, ()) if k and len(full) > size + overlap else [full]
    return out


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("", 10, 2, []),
        ("x" * 25, 10, 0, ["x" * 10, "x" * 10, "x" * 5]),
        ("abcdefghijklmnopqrstuvwxy", 10, 4, ["abcdefghij", "ghijklmnop", "mnopqrstuv", "stuvwxy", "y"]),
        ("甲乙丙。丁戊己；庚辛", 6, 0, ["甲乙丙", "丁戊己；庚辛"]),
        ("甲乙丙。丁戊己；庚辛", 7, 2, ["甲乙丙", "乙丙丁戊己；庚辛"]),
        ("one two three four", 9, 3, ["one two", "twothree", "reefour"]),
        ("a.b,c d", 3, 0, ["a", "b", "c d"]),
        ("\n## A\n## B and more", 8, 0, ["A", "B and", "more"]),
        ("aaaa bbbbbbbbbbbb cc", 6, 2, ["aaaa", "aabbbbbb", "bbbbbbbb", "bbbbbb", "bbcc"]),
    ],
)
def test_hand_worked(text, size, overlap, want):
    got = chunking.split(text, size, overlap)
    assert got == plain(text, size, overlap, chunking.SEPARATORS)
    assert got == want


def test_random_texts_match_the_plain_rule():
    r = random.Random(4)
    alphabet = ["a", "bc", "学习", " ", " ", ",", "，", ".", ";", "；", "。", "\n", "\n\n", "\n## ", "\n### ", "x" * 30]
    for _ in range(400):
        text = "".join(r.choices(alphabet, k=r.randrange(80)))
        size = r.randrange(1, 40)
        overlap = r.randrange(size + 3)
        assert chunking.split(text, size, overlap) == plain(text, size, overlap, chunking.SEPARATORS)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r.document_id, r.position): (r.section, r.text) for r in QUERIES["fm1_recursive_chunks"](spark, SF).collect()}
    want = {}
    for d, t in docs.items():
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", (t or "").replace("\0", "").replace("\r\n", "\n").replace("\r", "\n"))).strip()
        section = "全文"
        for k, c in enumerate(plain(t, 700, 90, chunking.SEPARATORS)):
            c = c.strip()
            line = c.splitlines()[0].strip() if c else ""
            if m := re.match(r"^#{1,6}\s+(.+)$", line):
                section = m[1].strip()
            elif 0 < len(line) <= 32 and line[-1] in ":：":
                section = line.rstrip(":：") or section
            if c:
                want[d, k] = (section, c)
    assert got == want and len(got) > len(docs)


def test_sections_are_carried(spark):
    docs = spark.createDataFrame([(1, "# Raft\nlog text\n\n结论：\n" + "词" * 15), (2, None), (3, " \n ")], "document_id long, text string")
    got = [(r.position, r.section, len(r.text)) for r in chunking.chunk(docs, 20, 0).orderBy("position").collect()]
    assert got[0][:2] == (0, "Raft") and {s for _, s, _ in got} == {"Raft", "结论"}
    rows = [(1, 0, "text", None, "# Raft\nlog"), (1, 1, "code", None, "# no heading"), (1, 2, "text", "Titled", "plain"), (1, 3, "heading", None, "#: "), (1, 4, "text", None, "结论：\n完")]
    blocks = spark.createDataFrame(rows, "document_id long, place int, block_type string, section_title string, text string")
    assert [r.section for r in index.block_chunks(blocks).orderBy("position").collect()] == ["Raft", "Raft", "Titled", "#", "结论"]
