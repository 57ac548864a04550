"""Sketches as stored data: made once for each day, merged later for any longer span without reading the rows again."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import load, query, scratch

#: For each kind of sketch: what makes one from rows, what merges several, and what reads one ({} is the column).
KINDS = {
    "hll": ("hll_sketch_agg({}, 12)", "hll_union_agg({})", "hll_sketch_estimate({})"),
    "theta": ("theta_sketch_agg({}, 12)", "theta_union_agg({}, 12)", "theta_sketch_estimate({})"),
    "kll": ("kll_sketch_agg_double({}, 400)", "kll_merge_agg_double({}, 400)", "kll_sketch_get_n_double({})"),
    "top": ("approx_top_k_accumulate({}, 10000)", "approx_top_k_combine({}, 10000)", "approx_top_k_estimate({}, 5)"),
}
#: Bounds that hold with high probability: three standard errors of 2^12 registers or entries, and a KLL sketch's rank error.
HLL_ERROR, THETA_ERROR, KLL_ERROR = 3 * 1.04 / 64, 3 / 64, 0.01


def sketched(rows: DataFrame, keys: list, sketches: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each key with its sketches; sketches: name to (kind, column or expression). Partial sketches merge before the shuffle."""
    return rows.groupBy(*keys).agg(*[F.expr(KINDS[kind][0].format(of)).alias(name) for name, (kind, of) in sketches.items()])


def merged(stored: DataFrame, keys: list, sketches: dict[str, tuple[str, str]]) -> DataFrame:
    """Sketches of coarser keys from those of finer ones, such as weeks from days, or of days that got more rows later."""
    return stored.groupBy(*keys).agg(*[F.expr(KINDS[kind][1].format(name)).alias(name) for name, (kind, _) in sketches.items()])


def estimate(name: str, kind: str):
    return F.expr(KINDS[kind][2].format(name))


_DAILY = {"users": ("hll", "user_id"), "clickers": ("theta", "IF(event_type = 'click', user_id, NULL)"), "buyers": ("theta", "IF(event_type = 'purchase', user_id, NULL)"), "spent": ("kll", "value"), "kinds": ("top", "event_type")}


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches of each day of events, written to the shared folder once and read from there."""
    path = scratch(spark)
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    sketched(events, ["day"], _DAILY).write.parquet(path)
    return spark.read.parquet(path)


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(daily_sketches(spark, sf_dir).withColumn("week", F.date_trunc("week", "day").cast("date")), ["week"], _DAILY)


@query(
    """SELECT week, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users, true AS users_near, true AS clickers_near, true AS buyers_near, true AS both_near, true AS either_near
    FROM (SELECT *, date_trunc('week', ts)::DATE AS week FROM events) GROUP BY week"""
)
def weekly_distinct_from_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users a week from daily sketches (HLL), clickers and buyers, and those who are both or either (theta), each within its bound of the exact number."""
    weeks = _weekly(spark, sf_dir)
    events = load(spark, sf_dir, "events").withColumn("week", F.date_trunc("week", "ts").cast("date"))
    users = events.groupBy("week", "user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "click").alias("c"), F.bool_or(F.col("event_type") == "purchase").alias("p"))
    number = lambda c: F.count_if(c)
    exact = users.groupBy("week").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_users"), number(F.col("c")).alias("x_c"), number(F.col("p")).alias("x_p"), number(F.col("c") & F.col("p")).alias("x_both"), number(F.col("c") | F.col("p")).alias("x_either"))
    near = lambda e, x, share, of=None: F.abs(F.expr(e) - F.col(x)) <= share * F.col(of or x) + 0.5
    return weeks.join(exact, "week").select(
        "week", "n", "n_users",
        near("hll_sketch_estimate(users)", "n_users", HLL_ERROR).alias("users_near"),
        near("theta_sketch_estimate(clickers)", "x_c", THETA_ERROR).alias("clickers_near"),
        near("theta_sketch_estimate(buyers)", "x_p", THETA_ERROR).alias("buyers_near"),
        near("theta_sketch_estimate(theta_intersection(clickers, buyers))", "x_both", THETA_ERROR, "x_either").alias("both_near"),  # an intersection errs by a share of the union
        near("theta_sketch_estimate(theta_union(clickers, buyers))", "x_either", THETA_ERROR).alias("either_near"),
    )


@query("SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def weekly_top_from_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of events a week by merged top-k sketches; these track 10,000 items, so the counts of five kinds are exact."""
    top = _weekly(spark, sf_dir).select("week", F.explode(estimate("kinds", "top")).alias("t"))
    return top.select("week", F.col("t.item").alias("event_type"), F.col("t.count").alias("n"))


@query(
    """SELECT week, q, count(*)::BIGINT AS n, true AS near FROM (SELECT date_trunc('week', ts)::DATE AS week FROM events), (VALUES (0.1::DOUBLE), (0.5), (0.9)) AS t(q) GROUP BY ALL"""
)
def weekly_quantiles_from_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles a week by merged KLL sketches: the share of the week's values up to the estimate is within the rank error of q."""
    q = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.expr(f"kll_sketch_get_quantile_double(spent, {q})").alias("v")) for q in (0.1, 0.5, 0.9)])).alias("t")
    found = _weekly(spark, sf_dir).select("week", estimate("spent", "kll").alias("n"), q).select("week", "n", "t.q", "t.v")
    events = load(spark, sf_dir, "events").select(F.date_trunc("week", "ts").cast("date").alias("week"), "value")
    shares = events.join(F.broadcast(found.select("week", "q", "v")), "week").groupBy("week", "q").agg((F.count_if(F.col("value") < F.col("v")) / F.count("value")).alias("below"), (F.count_if(F.col("value") <= F.col("v")) / F.count("value")).alias("upto"))  # three rows a week
    return found.join(shares, ["week", "q"]).select("week", "q", "n", ((F.col("below") <= F.col("q") + KLL_ERROR) & (F.col("upto") >= F.col("q") - KLL_ERROR)).alias("near"))


# -- count-min sketches, read back --------------------------------------------------------------------------

_M31 = 2**31 - 1


def count_min_shape(eps: float, confidence: float) -> tuple[int, int]:
    """Rows and cells a row of a sketch of these parameters."""
    return math.ceil(-math.log1p(-confidence) / math.log(2)), math.ceil(2 / eps)


def count_min_factors(seed: int, depth: int) -> list[int]:
    """The multipliers of a sketch's rows: whole numbers below 2^31 - 1 by the 48-bit linear congruential generator that java.util.Random documents."""
    state, out = (seed ^ 0x5DEECE66D) & (2**48 - 1), []
    while len(out) < depth:
        state = (state * 0x5DEECE66D + 0xB) & (2**48 - 1)
        if (state >> 17) < _M31:
            out.append(state >> 17)
    return out


def count_min_cells(sketches: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """keys, level, cell, factor, width, n: the table in a sketch's bytes (a version, the total, depth, width, a factor a row, and the cells, big-endian)."""
    number = lambda at, size: F.conv(F.hex(F.substring(name, at, size)), 16, 10).cast("long")
    head = sketches.select(*keys, name, number(F.lit(13), F.lit(4)).alias("depth"), number(F.lit(17), F.lit(4)).alias("width"))
    levels = head.select("*", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level")).withColumn("factor", number((21 + 8 * F.col("level")).cast("int"), F.lit(8)))
    cells = levels.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("cell"))
    at = 21 + 8 * (F.col("depth") + F.col("level") * F.col("width") + F.col("cell"))
    return cells.select(*keys, "level", "cell", "factor", "width", number(at.cast("int"), F.lit(8)).alias("n"))


def count_min_estimates(items: DataFrame, item: str, sketches: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """items: item (a long) and keys. Adds estimate: the least of the item's cells in its key's sketch, 0 without one.

    A sketch never counts an item too low. Each item meets as many cells as a sketch has rows; the tables are joined, so
    sketches of many keys are no broadcast. The product of factor and item is taken in halves, as it can pass 64 bits.
    """
    cells = count_min_cells(sketches, name, keys)
    shape = cells.where("cell = 0").select(*keys, "level", "factor", "width")
    x = F.col(item)
    low = F.col("factor") * x.bitwiseAND(F.lit(2**32 - 1))
    high = F.shiftright(low, 32) + F.col("factor") * F.shiftright(x, 32)
    cell = (low.bitwiseAND(F.lit(_M31)) + high.bitwiseAND(F.lit(_M31))).bitwiseAND(F.lit(_M31)) % F.col("width")
    on = [*keys, "level", "cell"]
    probes = items.join(shape, keys) if keys else items.crossJoin(F.broadcast(shape))  # without keys: a row for each row of the one sketch
    met = probes.withColumn("cell", cell).join(cells.select(*on, "n"), on)
    least = met.groupBy(*keys, item).agg(F.min("n").alias("estimate"))
    return items.join(least, [*keys, item], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0).cast("long")))


EPS, CONFIDENCE, SEED = 0.002, 0.99, 7
_DEPTH, _WIDTH = count_min_shape(EPS, CONFIDENCE)


@query(
    f"""WITH f(level, factor) AS (VALUES {", ".join(f"({i}, {a}::BIGINT)" for i, a in enumerate(count_min_factors(SEED, _DEPTH)))}),
c AS (SELECT l_returnflag, level, ((factor * l_partkey) + ((factor * l_partkey) >> 32)) % {_M31 + 1} % {_WIDTH} AS cell, count(*) AS n FROM lineitem, f GROUP BY ALL),
p AS (SELECT l_returnflag, p_partkey, min(coalesce(n, 0)) AS estimate FROM (SELECT DISTINCT l_returnflag FROM lineitem) CROSS JOIN part CROSS JOIN f
  LEFT JOIN c USING (l_returnflag, level) WHERE cell = ((factor * p_partkey) + ((factor * p_partkey) >> 32)) % {_M31 + 1} % {_WIDTH} GROUP BY ALL),
x AS (SELECT l_returnflag, l_partkey, count(*) AS exact FROM lineitem GROUP BY ALL), t AS (SELECT l_returnflag, count(*) AS total FROM lineitem GROUP BY ALL)
SELECT l_returnflag, p_partkey, coalesce(estimate, 0)::BIGINT AS estimate, coalesce(exact, 0)::BIGINT AS exact, coalesce(estimate, 0) >= coalesce(exact, 0) AS not_below, coalesce(estimate, 0) - coalesce(exact, 0) <= {EPS} * total AS within
FROM (SELECT DISTINCT l_returnflag FROM lineitem) CROSS JOIN part LEFT JOIN p USING (l_returnflag, p_partkey) LEFT JOIN x ON x.l_returnflag = p.l_returnflag AND l_partkey = p_partkey JOIN t USING (l_returnflag)"""
)
def count_min_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point estimates of every part in each flag's sketch beside the exact counts; SQL builds the same tables of cells by itself."""
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey")
    made = rows.groupBy("l_returnflag").agg(F.count_min_sketch("l_partkey", F.lit(EPS), F.lit(CONFIDENCE), F.lit(SEED)).alias("cms"), F.count(F.lit(1)).alias("total"))
    path = scratch(spark)
    made.write.parquet(path)
    stored = spark.read.parquet(path)
    exact = rows.groupBy("l_returnflag", F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("exact"))
    items = load(spark, sf_dir, "part").select("p_partkey").crossJoin(F.broadcast(stored.select("l_returnflag")))  # a row for each of the sketches
    found = count_min_estimates(items, "p_partkey", stored.select("l_returnflag", "cms"), "cms", ["l_returnflag"])
    joined = found.join(exact, ["l_returnflag", "p_partkey"], "left").join(stored.select("l_returnflag", "total"), "l_returnflag").withColumn("exact", F.coalesce("exact", F.lit(0).cast("long")))
    over = F.col("estimate") - F.col("exact")
    return joined.select("l_returnflag", "p_partkey", "estimate", "exact", (over >= 0).alias("not_below"), (over <= EPS * F.col("total")).alias("within"))
