"""Quality rules as a bitmask ledger: each rule is evaluated once, policies and ablations only read its bits.

`ledger` measures every document once and stores one failure bit per rule. A policy is a version and a mask of
bits: a document is kept if no bit of the mask is set. Ablations aggregate the few distinct bit patterns.
Everything is a native column expression.

Null text counts as empty: no words, and so it fails the base rule. Repeated rows are judged alike, each on its
own. Columns besides doc_id and text are ignored. An empty table gives an empty ledger. Windows of three words
are compared by 64-bit hashes of the words in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of a text's words that may lie in repeated three-word windows.
REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """Fails where `fails` holds; the bit of a rule is its place in RULES and never changes."""

    name: str
    fails: Column | str


RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_words", f"100 * n_repeat_words > {REPEATED_PERCENT} * n_words"),
    Rule("symbols", "n_symbols * 4 > n_words"),
    Rule("duplicate_lines", "n_dup_lines * 2 > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("exclamations", "n_exclaim * 5 > n_words"),
    Rule("capitals", "n_upper * 2 > word_chars"),
)
BASE = 0b0000011
#: Versions are only added, so that an old decision can be repeated.
POLICIES = {1: 0b0011111, 2: 0b1111111}
DEFAULT_POLICY = 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the optimiser moves or copies the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, each word once."""
    windows = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    places = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))
    reach = lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    total = lambda p: F.aggregate(reach(p), F.lit(0), lambda a, x: a + x)
    return _let(words, lambda w: _let(F.sort_array(windows(w)), lambda s: _let(places(s), total)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `failed`: bit k is set if RULES[k] fails."""
    text = F.coalesce("text", F.lit(""))
    long = lambda c: c.cast("long")
    df = only(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(f"[{SYMBOLS}]"))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.regexp_count("text", F.lit("!"))).alias("n_exclaim"),
        long(F.regexp_count("text", F.lit(r"\p{Lu}"))).alias("n_upper"),
        long(repeated_words(F.col("words"))).alias("n_repeat_words"),
    )
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails) if isinstance(rule.fails, str) else rule.fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("failed", bits)


def apply_policy(judged: DataFrame, version: int = DEFAULT_POLICY) -> DataFrame:
    """Adds base_failed and kept under one policy, without looking at a text again."""
    fails = lambda mask: F.col("failed").bitwiseAND(F.lit(mask).cast("long")) != 0
    return judged.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(BASE | POLICIES[version])).withColumn("policy", F.lit(version))


def ablations(judged: DataFrame, policies: dict[int, int] | None = None) -> DataFrame:
    """For each policy and rule of it: documents rejected, rejected without the rule, and by the rule alone."""
    masks = sorted((policies or POLICIES).items())
    cases = [(v, k, RULES[k].name, m) for v, m in masks for k in range(len(RULES)) if m >> k & 1]
    patterns = judged.groupBy("failed").agg(F.count("*").alias("n"))
    case = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(k).alias("bit"), F.lit(name).alias("rule"), F.lit(m).cast("long").alias("mask")) for v, k, name, m in cases])).alias("case")
    rows = patterns.select("failed", "n", case).select("failed", "n", "case.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    bit = F.expr("shiftleft(1L, bit)")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("policy", "bit", "rule").agg(
        total(hit != 0).alias("rejected"),
        total(hit.bitwiseAND(F.bitwise_not(bit)) != 0).alias("rejected_without"),
        total(hit == bit).alias("rejected_alone"),
        F.bit_or(hit).alias("bits_seen"),
    )
