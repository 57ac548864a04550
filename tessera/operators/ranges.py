"""Ranks and exact quantiles by ranges of the order, so that a group that holds much of all rows is many tasks.

Rows are dealt by ranges of group and order (rows equal in both stay together), and each range's part of a group is
counted. Counts before a range are sums over at most as many rows as there are ranges. Within a range ranks are local,
and adding what comes before makes them ranks of the group. For quantiles only the ranges that hold a wanted rank are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query, scratch


def _dealt(rows: DataFrame, keys: list[str], order: list[Column], size: Column) -> tuple[DataFrame, DataFrame]:
    """The rows by ranges, written once, with _group, _range; and for each part: _before, _groups_before (distinct orders), _total."""
    spark = rows.sparkSession
    named = rows.withColumn("_group", F.struct(*keys) if keys else F.struct(F.lit(0)))  # structs with nulls are equal
    path = scratch(spark)
    named.repartitionByRange("_group", *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    parts = dealt.groupBy("_group", "_range").agg(F.sum(size).alias("_size"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, parts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("_total", F.sum("_size").over(Window.partitionBy("_group")))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and one column for each share: the continuous quantile (as percentile_cont). Null values don't count.

    Equal values are counted before they are dealt, so one that holds much of a group is one row. No task and no
    aggregate holds all values of a group. A group of null values alone has no row. A null key is a group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt, parts = _dealt(counted, keys, [F.col(value)], F.col("_n"))
    place = lambda q: F.lit(q) * (F.col("_total") - 1)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), (place(q) - F.floor(place(q))).alias("part"), at.cast("long").alias("at"), F.lit(up).alias("up")) for name, q in shares.items() for up, at in ((False, F.floor(place(q))), (True, F.ceil(place(q))))])
    hit = parts.select("_group", "_range", "_before", "_size", F.explode(wanted).alias("w")).where((F.col("w.at") >= F.col("_before")) & (F.col("w.at") < F.col("_before") + F.col("_size")))
    hits = hit.groupBy("_group", "_range").agg(F.first("_before").alias("_before"), F.collect_list("w").alias("w"))  # two for each share at most
    running = F.sum("_n").over(Window.partitionBy("_group", "_range").orderBy(value))
    own = dealt.join(hits, ["_group", "_range"]).withColumn("_to", F.col("_before") + running)
    met = own.select("_group", F.col(value).cast("double").alias("v"), (F.col("_to") - F.col("_n")).alias("_from"), "_to", F.explode("w").alias("w")).where((F.col("w.at") >= F.col("_from")) & (F.col("w.at") < F.col("_to")))
    pick = lambda name, up: F.max(F.when((F.col("w.name") == name) & (F.col("w.up") == up), F.struct("v", "w.part")))
    found = met.groupBy("_group").agg(*[f for name in shares for f in (pick(name, False).alias(f"_low_{name}"), pick(name, True).alias(f"_high_{name}"))])
    mid = lambda name: F.col(f"_low_{name}.v") + (F.col(f"_high_{name}.v") - F.col(f"_low_{name}.v")) * F.col(f"_low_{name}.part")
    return found.select(*[F.col(f"_group.`{k}`").alias(k) for k in keys], *[mid(name).alias(name) for name in shares])


def ranked(rows: DataFrame, keys: list[str], order: list[str], then: list[str]) -> DataFrame:
    """Adds row_number, rank, dense_rank, cume_dist, percent_rank and group_size of each row in its group.

    order: columns, ascending with nulls first; rows equal in them are peers. then: what orders peers for row_number.
    """
    dealt, parts = _dealt(rows, keys, [F.col(c) for c in order], F.lit(1))
    w = Window.partitionBy("_group", "_range")
    peers = w.orderBy(*order)
    local = dealt.withColumns({"_rn": F.row_number().over(w.orderBy(*order, *then)), "_rk": F.rank().over(peers), "_dr": F.dense_rank().over(peers), "_upto": F.count(F.lit(1)).over(peers)})
    distinct = dealt.groupBy("_group", "_range", *order).agg(F.lit(1).alias("_one")).groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_kinds"))
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(distinct, ["_group", "_range"]).withColumn("_kinds", F.coalesce(F.sum("_kinds").over(earlier), F.lit(0)))
    joined = local.join(parts, ["_group", "_range"])
    n = F.col("_total")
    return joined.withColumns({
        "row_number": F.col("_before") + F.col("_rn"), "rank": F.col("_before") + F.col("_rk"), "dense_rank": F.col("_kinds") + F.col("_dr"), "group_size": n,
        "cume_dist": (F.col("_before") + F.col("_upto")) / n, "percent_rank": F.when(n > 1, (F.col("_before") + F.col("_rk") - 1) / (n - 1)).otherwise(0.0),
    }).drop("_group", "_range", "_rn", "_rk", "_dr", "_upto", "_kinds", "_before", "_total", "_size")


def tile(n: int) -> Column:
    """NTILE(n) from the columns of ranked(): the first tiles are one larger where n doesn't divide the group."""
    size, at = F.col("group_size"), F.col("row_number") - 1
    small, large = F.floor(size / n), size % n
    cut = large * (small + 1)
    return F.when(at < cut, F.floor(at / (small + 1))).otherwise(large + F.floor((at - cut) / F.greatest(small, F.lit(1)))) + 1


@query("SELECT event_type, ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.9), 6) AS p90, ROUND(median(value), 6) AS med FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of five large groups."""
    found = exact_quantiles(load(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), F.round("p50", 6).alias("med"))


@query("SELECT ROUND(quantile_cont(l_extendedprice, 0.001), 4) AS least, ROUND(quantile_cont(l_extendedprice, 0.25), 4) AS q1, ROUND(quantile_cont(l_extendedprice, 0.75), 4) AS q3, ROUND(quantile_cont(l_extendedprice, 0.999), 4) AS most FROM lineitem")
def percentiles_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the whole table as one group."""
    found = exact_quantiles(load(spark, sf_dir, "lineitem"), [], "l_extendedprice", {"least": 0.001, "q1": 0.25, "q3": 0.75, "most": 0.999})
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id))::INTEGER AS rn, (rank() OVER w)::INTEGER AS rk, (dense_rank() OVER w)::INTEGER AS dr FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id)")
def ranking_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in five large groups."""
    r = ranked(load(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), ["event_type"], ["user_id"], ["event_id"])
    return r.select("event_id", F.col("row_number").cast("int").alias("rn"), F.col("rank").cast("int").alias("rk"), F.col("dense_rank").cast("int").alias("dr"))


@query("SELECT event_id, (ntile(7) OVER (PARTITION BY event_type ORDER BY value, event_id))::INTEGER AS nt, ROUND(percent_rank() OVER w, 8) AS pr, ROUND(cume_dist() OVER w, 8) AS cd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)")
def distribution_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(load(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], ["value"], ["event_id"])
    return r.select("event_id", tile(7).cast("int").alias("nt"), F.round("percent_rank", 8).alias("pr"), F.round("cume_dist", 8).alias("cd"))
