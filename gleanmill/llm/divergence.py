"""Source divergence audit: how far the word use of a source is from the other sources of its language, and in which words.

Plain relations: the terms of every text are exploded and counted by language and source; a language keeps the terms of
at least LEAST_DOCS of its documents; groups meet the kept terms of their language, so that a term which a group does
not use counts zero; the groups of a language meet on language and term, and their divergences are summed and ranked.
All arithmetic is on whole numbers: a smoothed share p = 1 + floor(SCALE (count + 2) / (N + 2 V)), and the divergence of
two shares is floor((p - q)^2 / (p + q)).

The corpus is read once for its terms. What is counted there is summed in each task before it is shuffled, so that a
source with a third of all rows is a row for each term and task; terms below the bound go before anything else is done.
Kept terms are dealt by blocks of BLOCK_TERMS of a language, whose number follows from the language's own count of
terms. The pairs of a language's sources are rows of the result; they are made once and mirrored.

Null texts, languages and sources count as empty ones. Empty texts and texts without terms have no terms, but their
group is there with zero counts. Long texts are read whole. Repeated rows and rows of one doc_id are documents of their
own (doc_id is not read). Ties are broken by the item in the order of its bytes. Extra columns are ignored, an empty
table gives no rows, and a language that keeps no term has pairs of value 0.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only

#: What parts terms: a term is a run of other characters. Fixed value of the contract.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
TOP_TERMS = 10
#: Kept terms of a language that meet all groups in one task.
BLOCK_TERMS = 10_000


def _lower(text: Column) -> Column:
    """A-Z only: where every character is one byte, lower() does no more than that, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def read(docs: DataFrame) -> DataFrame:
    """lang, source and text without nulls."""
    return only(docs, "lang", "source", "text").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and the documents with it.

    A text's terms are exploded as they stand and once more without repeats, so one sum gives both counts.
    """
    terms = docs.select("lang", "source", F.split(_lower(F.col("text")), GAP).alias("terms"))
    twice = F.array(F.struct(F.lit(0).alias("once"), F.col("terms")), F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("terms")))
    each = terms.select("lang", "source", F.explode(twice).alias("s")).select("lang", "source", F.col("s.once").alias("once"), F.explode("s.terms").alias("term"))
    return each.filter("term <> ''").groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), a long division in two steps: exact up to 9 * 10^13 occurrences, beyond which it fails and does not wrap."""
    scaled, of = f"({n} + 2) * 100000L", f"({total} + 2 * {terms})"
    return F.expr(f"1 + ({scaled} div {of}) * 10000L + (({scaled} % {of}) * 10000L) div {of}")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """docs: (lang, source, text). Part `pair`: every other source of the group's language and their divergence over all
    kept terms; part `term`: the words that the group uses more than its language does, the top_terms first ones."""
    docs = read(docs)
    of_term = Window.partitionBy("lang", "term")
    seen = counts(docs).withColumn("in_lang", F.sum("docs").over(of_term)).filter(F.col("in_lang") >= least_docs)
    seen = cut(seen.select("lang", "source", "term", "n"), "terms")
    vocabulary = seen.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    languages = vocabulary.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(seen.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(languages, "lang", "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "v")]), "groups")
    pair = _pairs(groups, seen, vocabulary)
    term = _terms(groups, seen, vocabulary).filter(F.col("rank") <= top_terms)
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(groups: DataFrame, seen: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """All kept terms for every group (zeros too), the groups of a language against each other."""
    blocks = F.expr(f"v div {BLOCK_TERMS}")
    dealt = groups.select("lang", "source", "total", "v", F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("block"))
    sizes = groups.groupBy("lang").agg(F.max(blocks).alias("blocks"))
    kept = vocabulary.select("lang", "term").join(sizes, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), F.col("blocks") + 1).alias("block"))
    grid = kept.join(dealt, ["lang", "block"]).join(seen, ["lang", "source", "term"], "left")
    grid = grid.select("lang", "source", "term", F.coalesce("n", F.lit(0)).alias("n"), "total", "v").select("lang", "source", "term", share("n", "total", "v").alias("p"))
    other = grid.select("lang", F.col("source").alias("item"), "term", F.col("p").alias("q"))
    met = grid.join(other, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(divergence("p", "q")).alias("value"))
    names = groups.select("lang", "source")
    half = names.join(names.withColumnRenamed("source", "item"), "lang").filter("source < item").join(met, ["lang", "source", "item"], "left")
    half = half.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s"), F.coalesce("value", F.lit(0)).alias("value"))
    return _ranked(half.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value"))


def _terms(groups: DataFrame, seen: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The terms that a group uses, with its share and its language's."""
    both = seen.join(vocabulary.withColumnRenamed("n", "lang_n"), ["lang", "term"]).join(groups, ["lang", "source"])
    both = both.select("lang", "source", F.col("term").alias("item"), share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q"))
    return _ranked(both.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", divergence("p", "q").alias("value")))
