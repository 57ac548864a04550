"""Connected components of an edge list by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v. Returns node, root: the smallest node of its component, for every node but roots of their own.

    Every step keeps the number of edges at most that of the input and is written to the shared folder; the
    loop ends when a step changes nothing, which takes about the square of the logarithm of the number of nodes in
    steps and has no other limit. Hot nodes are joined on, never gathered. Without edges there are no rows.
    """
    now = saved(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(now)
    if not was[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        now = saved(_small_star(_large_star(now)))
        new = mark(now)
        if new == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = new
