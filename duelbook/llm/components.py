"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import cut


def _hooked(edges: DataFrame) -> DataFrame:
    """(u, v, m): each end u, its neighbours v, and the least of u and all of them."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that has a link; links: a, b (longs, any order, repeats allowed).

    A hub with very many links is combined before each shuffle, and joins on it are split at run time. Each round ends in a
    table, so a lost executor costs one round; the number of rounds grows with the logarithm of the longest path.
    """
    ab = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    ab = cut(ab)
    while True:
        # done where every node hangs on one other, and that one on none
        open_ = ab.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"))
        if open_.where("v < w").isEmpty() and ab.join(ab.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return ab.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                ab.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = ab.unionByName(ab.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_hooked(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = _hooked(large)
        ab = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
