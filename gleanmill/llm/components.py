"""Connected components of an edge table by alternating star contractions; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, salted_join


def _links(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long); root is the least id of its component.

    Each round points larger neighbours to a node's least neighbour and then smaller ones, until nothing changes; the
    rounds grow with the logarithm of the diameter. Hubs are reduced by partial minima before each shuffle, and their
    links are salted where they are joined. Self-links, repeated links and links in both directions are allowed; no
    edges give no rows.
    """
    now = cut(_links(only(edges, "u", "v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
    before, after = None, _state(now)
    while after != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _links(salted_join(both.filter("v > u"), least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")))
        joined = salted_join(large, large.groupBy("u").agg(F.min("v").alias("m")), ["u"], "v")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(_links(small), "edges")
        before, after = after, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
