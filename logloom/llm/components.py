"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouped minimum and a join on written tables, so a node of any degree is combined
before it is shuffled and its side of a join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import discard, materialize


def connected(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable from it, for each node of edges (a, b) but the roots."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = materialize(both.join(first, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        rest = large.join(least.filter("n > 1"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(before, first, large, least)
        # done when every node has one edge, to a node that has none
        if now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and now.groupBy("a").count().filter("count > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
