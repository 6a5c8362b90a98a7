"""Connected components by stars: nodes and their neighbours are tied to ever smaller nodes until each component is one star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import checkpoint


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Pairs (u, v), u > v, with the larger, or the other, neighbours of each node tied to the least of its neighbourhood."""
    sides = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.*") if larger else pairs
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = sides.join(least, "u")
    if larger:
        return tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    both = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return tied.select(both.alias("p")).select("p.*").where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (u, v), where root is the least node of its component.

    Self links name no other node and are left out. Rounds alternate large and small stars
    until the pairs stay the same, about the logarithm of the longest path; minima are
    combined before the shuffle, and joins of a hub can be split.
    """
    pairs = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    known = None
    while True:
        pairs = checkpoint(_star(_star(pairs, True), False))
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if now == known:
            stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.union(stars.select("root", "root").distinct())
        known = now
