"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.frames import drop, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a and b): root is the smallest node that links reach, in nodes' order.

    Alternates large-star and small-star steps until nothing changes, in about log^2 steps even for long chains. Minima combine
    before the shuffle, and hubs meet their minimum in a join that Spark splits when skewed; no neighbourhood is
    gathered in one task. Each round is written to the shared folder. Self-links and repeats are harmless, null ends are dropped.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # Large star: every neighbour above u hangs from the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours hang from the smallest of them. Here u is above v in every row.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
