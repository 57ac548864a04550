"""Projection, filters, joins, aggregates, sorts and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import load, query, scratch, sql
from .ranges import exact_quantiles

D = "CAST({} AS DECIMAL(14,2))"
REVENUE = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(1 - l_discount AS DECIMAL(4,2))) AS DOUBLE)"

# -- headline queries ---------------------------------------------------------------------------------------

sql(
    "pricing_summary",
    f"""SELECT l_returnflag, l_linestatus, CAST(SUM({D.format('l_quantity')}) AS DOUBLE) AS sum_qty, CAST(SUM({D.format('l_extendedprice')}) AS DOUBLE) AS sum_base_price,
    {REVENUE} AS sum_disc_price, ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_discount), 6) AS avg_disc, CAST(COUNT(*) AS BIGINT) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
sql(
    "shipping_priority",
    f"""SELECT l_orderkey, {REVENUE} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
sql(
    "local_supplier_volume",
    f"""SELECT n_name, {REVENUE} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
)
sql(
    "forecast_revenue",
    """SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
)
sql(
    "returned_items",
    f"""SELECT c_custkey, c_name, {REVENUE} AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
sql(
    "order_priority_exists",
    """SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS order_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""",
)
sql(
    "large_volume_customers",
    f"""SELECT c_name, o_orderkey, CAST(SUM({D.format('l_quantity')}) AS DOUBLE) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 250) GROUP BY c_name, o_orderkey""",
)
sql(
    "customer_distribution",
    """SELECT c_count, CAST(COUNT(*) AS BIGINT) AS custdist FROM (SELECT c_custkey, CAST(COUNT(o_orderkey) AS BIGINT) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) t GROUP BY c_count""",
)

# -- projection, filters, predicates ------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * 2 AS twice FROM lineitem WHERE l_quantity > 46 AND l_shipdate < TIMESTAMP '1996-06-01'")
def project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 46) & (F.col("l_shipdate") < F.lit("1996-06-01").cast("timestamp_ntz")))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 2).alias("twice"))


@query("SELECT p_partkey, p_name LIKE '%1%' AS has_one, lower(p_type) LIKE '%promo%' AS promo, regexp_matches(p_brand, '[13]$') AS odd, nullif(p_size, 7) IS NOT DISTINCT FROM NULL AS seven FROM part")
def pattern_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").like("%1%").alias("has_one"), F.col("p_type").ilike("%promo%").alias("promo"), F.col("p_brand").rlike("[13]$").alias("odd"), F.nullif(F.col("p_size"), F.lit(7)).eqNullSafe(F.lit(None)).alias("seven"))


sql("exists_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("not_in_null_aware", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
sql("not_in_with_nulls", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(user_id, 5) FROM events)")
sql("scalar_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > 1.5 * (SELECT AVG(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("conditionals", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, COALESCE(NULLIF(o_orderstatus, 'O'), 'open') AS status, CAST(o_totalprice BETWEEN 1000 AND 5000 AS INT) AS small FROM orders")


@query()
def table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows, the same ones each time (an operator whose feature is to sample)."""
    return load(spark, sf_dir, "orders").sample(fraction=0.1, seed=42).select("o_orderkey")


@query("SELECT count(*)::BIGINT AS n_rows, true AS near, true AS subset, true AS again, true AS apart FROM lineitem")
def table_sample_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the lines: the share is within five standard deviations, all rows are rows of the table, the same seed gives the same rows, and another seed others."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    key = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    mark = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("s"))
    one, same, other = mark(rows.sample(0.1, 7)), mark(rows.sample(0.1, 7)), mark(rows.sample(0.1, 8))
    outside = rows.sample(0.1, 7).exceptAll(rows).agg(F.count(F.lit(1)).alias("outside"))
    joined = rows.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(one).crossJoin(same.toDF("n2", "s2")).crossJoin(other.toDF("n3", "s3")).crossJoin(outside)  # one row each
    near = F.abs(F.col("n") - 0.1 * F.col("n_rows")) <= 5 * F.sqrt(0.09 * F.col("n_rows"))
    return joined.select("n_rows", near.alias("near"), (F.col("outside") == 0).alias("subset"), (F.col("s") == F.col("s2")).alias("again"), (F.col("s") != F.col("s3")).alias("apart"))


@query("SELECT l_returnflag, CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 END) AS BIGINT) AS F, CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 END) AS BIGINT) AS O FROM lineitem GROUP BY l_returnflag")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))


@query("SELECT s_suppkey, 'nation' AS what, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return s.unpivot("s_suppkey", ["nation", "balance"], "what", "value")


# -- joins --------------------------------------------------------------------------------------------------

_INNER = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"
sql("inner_join", _INNER)
sql("sort_merge_join", "SELECT /*+ MERGE(customer) */ o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", _INNER)
sql("shuffled_hash_join", "SELECT /*+ SHUFFLE_HASH(customer) */ o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", _INNER)
sql("left_outer_join", "SELECT c_custkey, event_id FROM customer LEFT JOIN events ON c_custkey = user_id")
sql("right_outer_join", "SELECT event_id, c_custkey FROM events RIGHT JOIN customer ON c_custkey = user_id AND event_type = 'error'")
sql("full_outer_join", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
sql("semi_join", "SELECT o_orderkey FROM orders LEFT SEMI JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'", "SELECT o_orderkey FROM orders SEMI JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey")
sql("anti_join", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON l_orderkey = o_orderkey", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
sql("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("natural_and_using_join", "SELECT doc_id, lang, toxic, quality FROM (SELECT doc_id, lang FROM documents) d NATURAL JOIN (SELECT doc_id, toxic FROM labels) l JOIN (SELECT doc_id, quality FROM labels) q USING (doc_id)")


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest orders of each customer.

    The price stays in the subquery up to the limit: where a projection stands between sort and limit, Spark 4.1 numbers
    the rows of a customer without an order, that is as they arrive, which over many partitions is any order.
    """
    own = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").where(F.col("o_custkey") == F.col("c_custkey").outer())
    most = own.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(2)
    return load(spark, sf_dir, "customer").select("c_custkey").lateralJoin(most).select("c_custkey", "o_orderkey")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= point < high, as an equi-join on buckets, in levels whose buckets are width, 2 width, 4 width, ...

    Each interval lies at the level where it meets at most three buckets, however wide it is, and a point looks into its
    bucket at each level that any interval lies at (64 at most). No nested loop over all pairs. Nulls and empty
    intervals match nothing.
    """
    sized = right.where(F.col(low) < F.col(high))
    level = F.greatest(F.lit(0), F.least(F.lit(63), F.ceil(F.log2((F.col(high) - F.col(low)) / F.lit(width))).cast("int")))
    levels = sorted(r[0] for r in sized.select(level).distinct().collect())  # at most 64 numbers
    bucket = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(2.0), F.col("_l")))).cast("long")
    a = left.withColumn("_l", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_b", bucket(point))
    b = sized.withColumn("_l", level).withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    return a.join(b, ["_l", "_b"]).where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop("_l", "_b")


@query("SELECT event_id, p_partkey FROM events JOIN (SELECT p_partkey, p_size + (p_partkey % 1000) / 1000.0::DOUBLE AS lo FROM part) p ON value >= lo AND value < lo + 0.0005::DOUBLE")
def theta_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow ranges, one a part."""
    events = load(spark, sf_dir, "events").select("event_id", "value")
    low = F.col("p_size") + (F.col("p_partkey") % 1000) / F.lit(1000.0)
    spans = load(spark, sf_dir, "part").select("p_partkey", low.alias("lo"), (low + F.lit(0.0005)).alias("hi"))
    return range_join(events, spans, "value", "lo", "hi", 0.01).select("event_id", "p_partkey")


@query("SELECT event_id, part.p_partkey FROM events JOIN part ON value >= p_size AND value < p_size + 2")
def theta_range_join_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide ranges, of which a point meets many."""
    events = load(spark, sf_dir, "events").select("event_id", "value")
    spans = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + 2).cast("double").alias("hi"))
    return range_join_of_classes(events, spans, "value", "lo", "hi", 2.0, "p_partkey").select("event_id", "p_partkey")


def range_join_of_classes(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, key: str) -> DataFrame:
    """range_join where many rows of `right` have the same interval: a point is held against each interval once, then meets the keys that have it.

    The keys of an interval are arrays of some 50,000 at most, however many it has. Up to 32 MB of them are broadcast,
    and `left` is dealt evenly over all tasks, whose results may be thousands of times what they read.
    """
    n = right.count()
    part = F.pmod(F.xxhash64(key), F.lit(-(-n // 50_000) or 1)).alias("_part")
    missing = F.array_repeat(F.lit(None).cast(dict(right.dtypes)[key]), F.count_if(F.col(key).isNull()).cast("int"))  # collect_list leaves nulls out
    classes = right.groupBy(low, high, part).agg(F.concat(F.collect_list(key), missing).alias("_keys")).drop("_part")
    if n * 8 <= 32 * 2**20:
        dealt = left.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        classes, left = F.broadcast(classes), dealt.sortWithinPartitions(point)  # neighbours meet the same keys, which then take little room when written
    met = range_join(left, classes, point, low, high, width)
    return met.select(*left.columns, low, high, F.explode("_keys").alias(key))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs whose half-open spans [low, high) overlap, as an equi-join on buckets, in levels whose buckets are width, 2 width, 4 width, ...

    A span belongs to the level where it meets at most three buckets, however wide it is. Two spans meet at the coarser
    of their levels only, and there in the bucket of the later start only, so no pair comes twice and no distinct is
    needed. A very wide span is three rows at each level that the other side has, never a row for each bucket below it.
    Spans that lie before or after all of the other side's are left out first. Nulls and empty spans match nothing. The
    columns of both sides must have different names.
    """
    base = lambda low, high: F.greatest(F.lit(0), F.least(F.lit(63), F.ceil(F.log2((F.col(high) - F.col(low)) / F.lit(width))).cast("int")))
    size = lambda level: F.lit(width) * F.pow(F.lit(2.0), level)
    bucket = lambda x, level: F.floor(x / size(level)).cast("long")
    sides = [(df.where(F.col(low) < F.col(high)).withColumn(own, base(low, high)), low, high, own) for df, (low, high), own in ((left, left_span, "_al"), (right, right_span, "_bl"))]
    seen = [df.groupBy(own).agg(F.min(low), F.max(high)).collect() for df, low, high, own in sides]  # at most 64 rows
    dealt = []
    for (df, low, high, own), other in zip(sides, reversed(seen)):
        levels = sorted(r[0] for r in other)
        if levels:  # at its own level if the other side has spans as narrow, and at each level of wider ones
            df = df.where((F.col(low) < F.lit(max(r[2] for r in other))) & (F.col(high) > F.lit(min(r[1] for r in other))))
            level = F.explode(F.expr(f"filter(array({', '.join(map(str, levels))}, {own}), (x, i) -> x > {own} OR (i = {len(levels)} AND x >= {levels[0]}))"))
        else:
            level = F.explode(F.array().cast("array<int>"))
        at = df.withColumn("_l", level)
        last = F.greatest(bucket(F.col(low), F.col("_l")), F.ceil(F.col(high) / size(F.col("_l"))).cast("long") - 1)  # high itself is outside
        dealt.append(at.withColumn("_b", F.explode(F.sequence(bucket(F.col(low), F.col("_l")), last))))
    (a, alow, ahigh, _), (b, blow, bhigh, _) = ((d, *s[1:]) for d, s in zip(dealt, sides))
    met = a.join(b, ["_l", "_b"]).where((F.col(alow) < F.col(bhigh)) & (F.col(blow) < F.col(ahigh)))
    once = (F.greatest("_al", "_bl") == F.col("_l")) & (bucket(F.greatest(alow, blow), F.col("_l")) == F.col("_b"))
    return met.where(once).drop("_l", "_b", "_al", "_bl")


_OVERLAP = """SELECT l_orderkey, l_linenumber, user_id, start FROM (
    SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) / 1e6 AS s, epoch_us(l_shipdate) / 1e6 + l_quantity * 3600 AS e FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-08-01 00:00:00') l
    JOIN (SELECT user_id, start, (start_s - 1704067200) + 901929600 AS us, (start_s - 1704067200) + 901929600 + n * n * 600 AS ue FROM (SELECT user_id, min(ts) AS start, epoch_us(min(ts)) / 1e6 AS start_s, count(*) AS n FROM events GROUP BY user_id, time_bucket(INTERVAL 1 DAY, ts))) u
    ON s < ue AND us < e"""


@query(_OVERLAP)
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose time of delivery overlaps a user's day of activity, as both are moved to the same month; the widths of both sides differ a hundredfold."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP '1998-08-01 00:00:00'").select("l_orderkey", "l_linenumber", at("l_shipdate").alias("s"), (at("l_shipdate") + F.col("l_quantity") * 3600).alias("e"))
    days = load(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))
    moved = at("start") - 1704067200 + 901929600
    spans = days.select("user_id", "start", moved.alias("us"), (moved + F.col("n") * F.col("n") * 600).alias("ue"))
    return overlap_join(lines, spans, ("s", "e"), ("us", "ue"), 3600.0).select("l_orderkey", "l_linenumber", "user_id", "start")


def bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Writes df as a table in so many buckets by key, sorted within, and reads it: later joins and groupings on key don't shuffle it."""
    spark = df.sparkSession
    df.repartition(buckets, key).write.mode("overwrite").option("path", scratch(spark)).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


@query("SELECT o_orderkey, o_orderpriority, count(*)::BIGINT AS n, CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines from tables kept in buckets by order: neither the join nor the grouping has an exchange."""
    run = uuid.uuid4().hex
    orders = bucketed(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), f"orders_{run}", "o_orderkey", 8)
    lines = bucketed(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), f"lineitem_{run}", "l_orderkey", 8)
    joined = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(14,2)")).cast("double").alias("qty"))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: str, values: list[str], span: str = "day") -> DataFrame:
    """For each left row the values of the last right row of its key at or before it: unions and windows, no pairs.

    A key is cut into spans of time (a unit of date_trunc), so that one that holds much of all rows is many groups. Each
    span has a row more, with the last right row of the spans before it, of which there is one a key and span.
    `on` and `by` have the same names on both sides; of right rows with one key and time the values must agree.
    """
    cut = F.date_trunc(span, F.col(on)) if dict(left.dtypes)[on].startswith("timestamp") else F.floor(F.col(on) / 1000)
    lcols = [c for c in left.columns if c not in (on, by)]
    held = F.struct(*values)
    a = left.select(by, on, cut.alias("_cut"), F.lit(2).alias("_side"), F.struct(*lcols).alias("_left"), F.lit(None).alias("_held"))
    b = right.where(F.col(on).isNotNull()).select(by, on, cut.alias("_cut"), F.lit(1).alias("_side"), F.lit(None).alias("_left"), held.alias("_held"))
    # one row a key and span: its last right row if any, carried on to later spans
    lasts = a.select(by, "_cut").distinct().join(b.groupBy(by, "_cut").agg(F.max_by("_held", on).alias("_held")), [by, "_cut"], "full")
    carried = F.last("_held", ignorenulls=True).over(Window.partitionBy(by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
    c = lasts.select(by, F.lit(None).alias(on), "_cut", F.lit(0).alias("_side"), F.lit(None).alias("_left"), carried.alias("_held"))
    w = Window.partitionBy(by, "_cut").orderBy(F.col(on).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.union(b).union(c).withColumn("_last", F.last("_held", ignorenulls=True).over(w)).where("_side = 2")
    return out.select(by, on, *[F.col(f"_left.{c}").alias(c) for c in lcols], *[F.col(f"_last.{v}").alias(v) for v in values])


@query(
    "SELECT e.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts"
)
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    return asof_join(buys, views, "ts", "user_id", ["view_id"]).select("event_id", "view_id")


@query("SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's events within six hours, joined by user and six-hour bucket, so that a busy user is many keys."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(6 * 3600 * 10**6)).cast("long")
    a = e.select(F.col("event_id").alias("first_id"), "user_id", F.col("ts").alias("ta"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = e.select(F.col("event_id").alias("second_id"), "user_id", F.col("ts").alias("tb"), bucket.alias("bucket"))
    return a.join(b, ["user_id", "bucket"]).where((F.col("tb") > F.col("ta")) & (F.col("tb") <= F.col("ta") + F.expr("INTERVAL 6 HOURS"))).select("first_id", "second_id")


def salted(big: DataFrame, small: DataFrame, key: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column _salt, which deals the hot keys of `big` over `parts` numbers and repeats their rows of `small` as often.

    A key is hot if it has over one in 256 of the rows of `big`, so there are 255 hot ones at most. All others have one salt.
    """
    n = big.count()
    hot = [r[0] for r in big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * 256 > n).select(key).collect()]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    a = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*big.columns), F.lit(parts)).cast("int")).otherwise(0))
    b = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return a, b


def salted_join(big: DataFrame, small: DataFrame, key: str, parts: int = 16) -> DataFrame:
    """An inner join for keys that hold much of all rows: each such key of `big` is dealt over `parts` tasks.

    Both sides are sorted and merged: Spark doesn't see that rows of `small` are repeated, and might send it whole to the
    driver and to each executor.
    """
    a, b = salted(big, small, key, parts)
    return a.join(b.hint("merge"), [key, "_salt"]).drop("_salt")


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def skew_salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"))
    return salted_join(events, load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "k").select("event_id", "c_name")


# -- aggregates ---------------------------------------------------------------------------------------------

sql("hash_aggregate", "SELECT c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(14,2))) AS DOUBLE) AS total, MIN(c_acctbal) AS least, MAX(c_acctbal) AS most FROM customer GROUP BY c_mktsegment")
sql("sort_aggregate", "SELECT n_regionkey, MAX(n_name) AS last_name, MIN(n_name) AS first_name FROM nation GROUP BY n_regionkey")
sql("multi_distinct", "SELECT l_returnflag, CAST(COUNT(DISTINCT l_orderkey) AS BIGINT) AS n_orders, CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS n_parts, CAST(COUNT(DISTINCT l_suppkey) AS BIGINT) AS n_supps FROM lineitem GROUP BY l_returnflag")
_CUBE = "SELECT o_orderstatus, o_orderpriority, CAST({} AS BIGINT) AS gid, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY {}"
sql("cube", _CUBE.format("GROUPING_ID(o_orderstatus, o_orderpriority)", "CUBE (o_orderstatus, o_orderpriority)"))
sql("rollup", _CUBE.format("GROUPING_ID(o_orderstatus, o_orderpriority)", "ROLLUP (o_orderstatus, o_orderpriority)"))
sql("grouping_sets", _CUBE.format("GROUPING_ID(o_orderstatus, o_orderpriority)", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
sql("filtered_aggregate", "SELECT user_id, CAST(COUNT(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, CAST(COUNT(*) FILTER (WHERE value > 50) AS BIGINT) AS large FROM events GROUP BY user_id")
sql("having", "SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")


@query("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def collect_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"))


@query("SELECT l_returnflag, true AS within FROM lineitem GROUP BY l_returnflag")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimate (relative standard deviation 2 %) is within 8 % of the exact number."""
    by = load(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    n = by.agg(F.approx_count_distinct("l_partkey", 0.02).alias("n")).join(by.agg(F.count_distinct("l_partkey").alias("exact")), "l_returnflag")
    return n.select("l_returnflag", (F.abs(F.col("n") - F.col("exact")) <= 0.08 * F.col("exact")).alias("within"))


sql("percentiles_of_users", "SELECT user_id, ROUND(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, ROUND(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90, ROUND(MEDIAN(value), 6) AS med FROM events GROUP BY user_id")
sql(
    "mode_of",
    "SELECT o_custkey, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS priority, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, o_orderpriority AS priority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS c, sum(count(*)) OVER (PARTITION BY o_custkey)::BIGINT AS n FROM orders GROUP BY o_custkey, o_orderpriority) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderpriority) = 1",
)
sql(
    "mode_of_all_groups",
    "SELECT c_nationkey, mode() WITHIN GROUP (ORDER BY seg) AS seg FROM (SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'a' WHEN c_custkey % 3 = 1 THEN 'b' ELSE 'c' END AS seg FROM customer) t GROUP BY c_nationkey",
    "SELECT c_nationkey, seg FROM (SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'a' WHEN c_custkey % 3 = 1 THEN 'b' ELSE 'c' END AS seg FROM customer) GROUP BY c_nationkey, seg QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, seg) = 1",
)
sql(
    "ordered_string_agg",
    "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
sql(
    "arg_max_and_regression",
    "SELECT event_type, max_by(event_id, ts) AS last_id, min_by(event_id, ts) AS first_id, ROUND(corr(value, user_id), 6) AS r, ROUND(regr_slope(value, user_id), 8) AS slope, ROUND(regr_intercept(value, user_id), 6) AS icept, ROUND(regr_r2(value, user_id), 6) AS r2 FROM events GROUP BY event_type",
    "SELECT event_type, arg_max(event_id, ts) AS last_id, arg_min(event_id, ts) AS first_id, ROUND(corr(value, user_id), 6) AS r, ROUND(regr_slope(value, user_id), 8) AS slope, ROUND(regr_intercept(value, user_id), 6) AS icept, ROUND(regr_r2(value, user_id), 6) AS r2 FROM events GROUP BY event_type",
)
sql("dispersion", "SELECT l_returnflag, ROUND(stddev(l_quantity), 6) AS sd, ROUND(stddev_pop(l_quantity), 6) AS sdp, ROUND(var_samp(l_quantity), 5) AS vs, ROUND(var_pop(l_quantity), 5) AS vp, ROUND(covar_pop(l_quantity, l_discount), 6) AS cp, ROUND(covar_samp(l_quantity, l_discount), 6) AS cs FROM lineitem GROUP BY l_returnflag")
sql(
    "moments",
    "SELECT c_mktsegment, ROUND(skewness(c_acctbal), 6) AS skew, ROUND(kurtosis(c_acctbal), 6) AS kurt FROM customer GROUP BY c_mktsegment",
    """SELECT c_mktsegment, ROUND(m3 / pow(m2, 1.5), 6) AS skew, ROUND(kurtosis_pop, 6) AS kurt FROM (
    SELECT c_mktsegment, avg(pow(c_acctbal - mu, 3)) AS m3, avg(pow(c_acctbal - mu, 2)) AS m2, avg(pow(c_acctbal - mu, 4)) / pow(avg(pow(c_acctbal - mu, 2)), 2) - 3 AS kurtosis_pop
    FROM (SELECT c_mktsegment, c_acctbal, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS mu FROM customer) GROUP BY c_mktsegment)""",
)
sql("bit_and_boolean", "SELECT c_nationkey, bit_and(c_custkey) AS ba, bit_or(c_custkey) AS bo, bit_xor(c_custkey) AS bx, bool_and(c_acctbal > 0) AS every_pos, bool_or(c_acctbal > 9000) AS any_rich, CAST(count_if(c_acctbal < 0) AS BIGINT) AS n_neg FROM customer GROUP BY c_nationkey")


@query("SELECT l_returnflag, true AS hll, true AS theta, true AS kll, true AS top, true AS cms, true AS approx_median, 5::INTEGER AS bins FROM lineitem GROUP BY l_returnflag")
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sketch held against what is exact: distinct numbers within 8 %, medians within a few of the fifty values, top counts equal."""
    rows = load(spark, sf_dir, "lineitem")
    most = rows.groupBy("l_returnflag", "l_linenumber").count().groupBy("l_returnflag").agg(F.max("count").alias("most"))
    # apart from the sketches: beside a distinct count each of them would be built for every distinct key
    exact = rows.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    made = rows.groupBy("l_returnflag").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("hll"),
        F.expr("theta_sketch_estimate(theta_sketch_agg(l_partkey))").alias("theta"),
        F.expr("kll_sketch_agg_double(l_quantity)").alias("kll"),
        F.expr("approx_top_k(l_linenumber, 2)").alias("top"),
        F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.95), F.lit(7)).alias("cms"),
        F.percentile_approx("l_quantity", 0.5, 10_000).alias("approx_median"),
        F.histogram_numeric("l_quantity", F.lit(5)).alias("histogram"),
    )
    near = lambda c: F.abs(F.col(c) - F.col("exact")) <= 0.08 * F.col("exact")
    kll = F.expr("kll_sketch_get_quantile_double(kll, 0.5)")
    middle = exact_quantiles(rows, ["l_returnflag"], "l_quantity", {"median": 0.5})
    return made.join(most, "l_returnflag").join(exact, "l_returnflag").join(middle, "l_returnflag").select(
        "l_returnflag", near("hll").alias("hll"), near("theta").alias("theta"), (F.abs(kll - F.col("median")) <= 3).alias("kll"), (F.col("top")[0]["count"] == F.col("most")).alias("top"),
        (F.length("cms") > 0).alias("cms"), (F.abs(F.col("approx_median") - F.col("median")) <= 1).alias("approx_median"), F.size("histogram").alias("bins"),
    )


sql("any_value_of", "SELECT o_custkey, any_value(o_custkey * 2) AS twice, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")


@query("SELECT o_orderstatus, o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority))")
def grouping_sets_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[status, priority], [priority]], status, priority).agg(F.count(F.lit(1)).alias("n"))


# -- sorts and limits ---------------------------------------------------------------------------------------

sql("global_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
sql("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
sql("sort_nulls", "SELECT s_suppkey, nullif(s_nationkey, 3) AS nk FROM supplier ORDER BY nk DESC NULLS FIRST, s_suppkey")
sql("sort_nulls_all_rows", "SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM customer ORDER BY nk ASC NULLS LAST, c_custkey")


@query("SELECT 10::BIGINT AS n")
def limit_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows come is not defined, how many is."""
    return load(spark, sf_dir, "orders").limit(10).agg(F.count(F.lit(1)).alias("n"))


# -- set operations and SQL forms ---------------------------------------------------------------------------

_C, _S = "SELECT c_custkey % 40 AS k FROM customer", "SELECT s_suppkey % 8 AS k FROM supplier"
for _op in ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
    sql(_op.lower().replace(" ", "_") + "_op", f"({_C}) {_op} ({_S})")
sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("common_table_expression", "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT MAX(n) AS m FROM big) SELECT o_custkey, CAST(n AS BIGINT) AS n FROM big, top WHERE n = m")
sql(
    "recursive_cte",  # customers as a binary tree: c is below c / 2
    "WITH RECURSIVE t(k, depth, root) AS (SELECT c_custkey, 0, c_custkey FROM customer WHERE c_custkey BETWEEN 1 AND 3 UNION ALL SELECT c_custkey, depth + 1, root FROM t JOIN customer ON c_custkey DIV 2 = k AND c_custkey > 3) SELECT k, depth, root FROM t",
    "WITH RECURSIVE t(k, depth, root) AS (SELECT c_custkey, 0, c_custkey FROM customer WHERE c_custkey BETWEEN 1 AND 3 UNION ALL SELECT c_custkey, depth + 1, root FROM t JOIN customer ON c_custkey // 2 = k AND c_custkey > 3) SELECT k, depth, root FROM t",
)
sql(
    "pipe_syntax",
    "FROM orders |> WHERE o_orderstatus = 'F' |> AGGREGATE COUNT(*) AS n GROUP BY o_orderpriority |> SELECT o_orderpriority, CAST(n AS BIGINT) AS n",
    "SELECT o_orderpriority, COUNT(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority",
)
sql("inline_values", "SELECT o_orderkey, urgency FROM orders JOIN (VALUES ('1-URGENT', 3), ('2-HIGH', 2), ('5-LOW', NULL)) AS t(name, urgency) ON o_orderpriority = name")


@query("SELECT id FROM (SELECT unnest(range((SELECT max(o_orderkey) + 1 FROM orders))) AS id) WHERE id NOT IN (SELECT o_orderkey FROM orders)")
def range_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that no order has, below the largest."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    most = orders.agg(F.max("id")).first()[0]
    return spark.range(0 if most is None else most + 1).join(orders, "id", "left_anti")
