"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworth.llm.common import written

MOST_ROUNDS = 60


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node points to one node, and no node that is pointed to points on."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    if several.count():
        return False
    return not edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of `edges` (a, b); self-loops and nulls are ignored.

    Large-star and small-star in turn: every node hands its larger neighbours, then its smaller ones, to the smallest
    it knows. Minima are taken before the shuffle, and a node with very many neighbours meets its minimum in a join
    that Spark can split. Every round is a written table. The number of rounds is about the logarithm of the longest path.
    """
    a, b = F.col("a"), F.col("b")
    start = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(start, "links")
    for _ in range(MOST_ROUNDS):
        if _is_forest_of_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.filter("u <> v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small-star")
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
