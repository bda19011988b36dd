"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The smallest node that each node reaches: rows (node, root) for every node that has an edge.

    Alternates large and small stars (Kiveris and others, 2014): every node links its larger, then
    its smaller neighbours to the smallest it knows, until nothing changes. Each round is a grouped minimum
    and an equi-join; rounds grow with the logarithm of the longest path. Edges are staged after each round, and minima before
    they are joined: both sides of a join are then shuffled for it alone, so that Spark splits a node with very many edges."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = staged(pairs, "edges")
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = staged(small.distinct(), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
