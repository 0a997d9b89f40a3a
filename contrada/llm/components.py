"""Connected components by alternating stars, as joins and aggregations; every round is written, nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): id and root, the smallest id that each reaches. Ends without an edge are not named; loops and repeats do no harm.

    Each round hangs every node's larger neighbours on its smallest (large star), then its smaller ones (small star); a tree of depth d
    shrinks to about its logarithm. Minima are partial before the shuffle, and hot nodes are only met in joins that may be split.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    # Done when all are stars: no node hangs on another and has nodes or another centre itself.
    while not (now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and now.groupBy("u").count().filter("count > 1").isEmpty()):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        hung = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        small = hung.join(least, "u")
        before, now = now, written(small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        discard(before)
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
