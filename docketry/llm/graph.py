"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.sampling import MOST_BROADCAST
from docketry.runtime import checkpoint


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of every node in links ``u``, ``v``.

    Each round hooks a node, and the root it has, to the smallest root among its
    neighbours and then skips to the root's root, so chains shrink by halves. A round
    ends in a checkpoint; the minima are combined before they are shuffled, and a hub's
    links meet its root in a join that adaptive execution can split. With ``parts`` a round's
    tables are written in so many files at most: they are small beside the session's partitions.
    Then roots, if few enough when counted, are broadcast, not sorted.
    """

    def written(df: DataFrame) -> DataFrame:
        return checkpoint(df.coalesce(parts) if parts else df)

    links = links.where(F.col("u") != F.col("v")).select("u", "v")
    links = written(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = written(links.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")))
    small = F.broadcast if parts and roots.count() <= MOST_BROADCAST else lambda df: df
    while True:
        of_u, of_v = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        seen = links.join(small(of_v), "v").join(small(of_u), "u").where(F.col("rv") < F.col("ru"))
        lower = seen.select(F.explode(F.array("u", "ru")).alias("node"), F.col("rv").alias("lower")).groupBy("node").agg(F.min("lower").alias("lower"))
        hooked = written(
            roots.join(small(lower), "node", "left").select("node", F.col("root").alias("before"), F.least("root", F.coalesce("lower", "root")).alias("root"))
        )
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = written(hooked.join(small(above), "root").select("node", "before", F.col("above").alias("root")))
        if roots.where(F.col("root") != F.col("before")).isEmpty():
            return roots.select("node", "root")
