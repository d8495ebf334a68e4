"""Connected components by alternating large-star and small-star steps.

Both steps are a minimum per node and a join with it, so hot nodes are
aggregated before the shuffle and salted in the join. Nothing is
collected but whether a round was the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.tables import dropped, salted, spread, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = salted(both.filter("b > a"), "b")
    return up.join(spread(least), ["a", "_salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = salted(down, "b").join(spread(least), ["a", "_salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def contracted(edges: DataFrame) -> tuple[DataFrame, str]:
    """Edges (a, b), b < a, after one round: fewer of them, with the same components; and their path."""
    return stored(_small_star(_large_star(edges.select("a", "b").filter("a <> b"))), "links")


def _is_star(edges: DataFrame) -> bool:
    """Whether every node points to one other that points nowhere."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    edges: (a, b), two longs; loops, repeats and both directions are allowed.
    Also returns the path of the stored result.
    """
    spark = edges.sparkSession
    now, path = contracted(edges)
    while not _is_star(now):
        following, new_path = contracted(now)
        dropped(spark, path)
        now, path = following, new_path
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()), path
