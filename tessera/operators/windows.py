"""Window functions, and the three window forms that Spark's SQL lacks, composed from those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query, sql

sql("ranking", "SELECT event_id, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id)".replace("row_number() OVER w", "row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id)"))
sql("distribution", "SELECT event_id, CAST(ntile(7) OVER (PARTITION BY event_type ORDER BY value, event_id) AS INT) AS nt, ROUND(percent_rank() OVER (PARTITION BY event_type ORDER BY value), 8) AS pr, ROUND(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 8) AS cd FROM events")
sql(
    "offsets",
    "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id, last_value(event_id) OVER w AS last_id, lag(nullif(event_id % 3, 0)) IGNORE NULLS OVER w AS prev_mod FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
    "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id, last_value(event_id) OVER w AS last_id, lag(nullif(event_id % 3, 0) IGNORE NULLS) OVER w AS prev_mod FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
)
sql("rows_frame", "SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DOUBLE) AS s, CAST(COUNT(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS BIGINT) AS n FROM events")
sql(
    "range_frame",
    "SELECT event_id, CAST(COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events",
)
sql("named_window", "SELECT event_id, CAST((COUNT(*) OVER w) AS BIGINT) AS n, CAST((MAX(event_id) OVER w) AS BIGINT) AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)")
sql("top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")
sql(
    "running_totals",
    "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS running, ROUND(o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders",
)


def qualify(df: DataFrame, keep: Column) -> DataFrame:
    """Rows where a condition on window functions holds (QUALIFY)."""
    return df.withColumn("_keep", keep).where("_keep").drop("_keep")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def qualify_emulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return qualify(load(spark, sf_dir, "events").select("event_id", "user_id", "value"), F.row_number().over(w) == 1).select("event_id")


def over_groups(df: DataFrame, agg: Column, partition: str, order: str, before: int, after: int, name: str) -> DataFrame:
    """A GROUPS frame: peers are numbered by dense_rank, and the frame is a RANGE over those numbers."""
    df = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(partition).orderBy(order)))
    return df.withColumn(name, agg.over(Window.partitionBy(partition).orderBy("_peer").rangeBetween(-before, after))).drop("_peer")


@query("SELECT c_custkey, CAST(COUNT(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n FROM customer")
def groups_frame_emulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_groups(load(spark, sf_dir, "customer"), F.count(F.lit(1)), "c_mktsegment", "c_nationkey", 1, 1, "n").select("c_custkey", "n")


@query("SELECT c_custkey, CAST(SUM(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM customer")
def exclude_current_emulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXCLUDE CURRENT ROW for a sum: the frame's sum less the row, null where the frame holds the row alone."""
    w = Window.partitionBy("c_mktsegment").orderBy("c_custkey").rowsBetween(-2, 2)
    c = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(c, F.when(F.count(c).over(w) > 1, F.sum(c).over(w) - c).alias("s"))


def excluding(df: DataFrame, value: str, partition: str, order: str, then: str, unit: str, before: int, after: int, exclude: str) -> DataFrame:
    """Adds n, least and most: COUNT, MIN and MAX of value over a frame around the row, with an EXCLUDE clause.

    unit: ROWS or GROUPS (peers: rows equal in order); the frame is `before` PRECEDING to `after` FOLLOWING. exclude:
    CURRENT ROW, GROUP, TIES or NO OTHERS. MIN and MAX can't be taken back from a frame, so what stays is put together
    from frames that end before the excluded rows and start after them: GROUPS frames over the numbers of the peers; the
    row's own peers by frames within them, by `then`, which must be unique. What a ROWS frame loses with the peers
    depends on the row, so there the frame itself (before + after + 1 values) is filtered. Null values count for nothing.
    """
    by, v = Window.partitionBy(partition), F.col(value)
    rows = by.orderBy(order, then)
    if unit == "ROWS" and exclude in ("GROUP", "TIES"):
        near = F.collect_list(F.struct(F.col(order).alias("o"), F.col(then).alias("t"), v.alias("v"))).over(rows.rowsBetween(-before, after))
        peer = lambda x: x["o"].eqNullSafe(F.col(order)) & (~x["t"].eqNullSafe(F.col(then)) if exclude == "TIES" else F.lit(True))
        kept = F.filter(F.transform(F.filter("_near", lambda x: ~peer(x)), lambda x: x["v"]), lambda x: x.isNotNull())
        return df.withColumn("_near", near).withColumns({"n": F.size(kept).cast("long"), "least": F.array_min(kept), "most": F.array_max(kept)}).drop("_near")
    if unit == "ROWS":
        frames = [rows.rowsBetween(-before, -1), rows.rowsBetween(1, after)] if exclude == "CURRENT ROW" else [rows.rowsBetween(-before, after)]
    else:
        df = df.withColumn("_peer", F.dense_rank().over(by.orderBy(order)))
        groups = by.orderBy("_peer")
        own = Window.partitionBy(partition, "_peer").orderBy(then)
        frames = [groups.rangeBetween(-before, after)] if exclude == "NO OTHERS" else [groups.rangeBetween(-before, -1), groups.rangeBetween(1, after)]
        if exclude == "CURRENT ROW":
            frames += [own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)]
        if exclude == "TIES":
            frames.append(own.rowsBetween(0, 0))
    join = lambda f, parts: f(*parts) if len(parts) > 1 else parts[0]
    n = sum((F.count(v).over(w) for w in frames[1:]), F.count(v).over(frames[0]))
    least, most = join(F.least, [F.min(v).over(w) for w in frames]), join(F.greatest, [F.max(v).over(w) for w in frames])
    return df.withColumns({"n": n, "least": least, "most": most}).drop("_peer")


def _excluding_query(unit: str, exclude: str) -> None:
    over = f"(PARTITION BY event_type ORDER BY user_id{', event_id' if unit == 'ROWS' else ''} {unit} BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE {exclude})"
    text = f"SELECT event_id, count(value) OVER w AS n, min(value) OVER w AS least, max(value) OVER w AS most FROM events WINDOW w AS {over}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
        return excluding(events, "value", "event_type", "user_id", "event_id", unit, 3, 2, exclude).select("event_id", "n", "least", "most")

    run.__name__ = f"exclude_{exclude.lower().replace(' ', '_')}_{unit.lower()}"
    query(text)(run)


for _unit, _exclude in (("ROWS", "CURRENT ROW"), ("GROUPS", "CURRENT ROW"), ("GROUPS", "GROUP"), ("GROUPS", "TIES"), ("GROUPS", "NO OTHERS")):
    _excluding_query(_unit, _exclude)
