"""Stored sketches, count-min point estimates, exact quantiles and ranks by ranges, on hand-made frames."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ranges, rollups

KINDS = {"h": ("hll", "u"), "t": ("theta", "u"), "k": ("kll", "v"), "top": ("top", "u")}


def estimates(df, *keys):
    return {tuple(r[k] for k in keys): (r.h, round(r.t), r.n, len(r.top)) for r in df.select(*keys, rollups.estimate("h", "hll").alias("h"), rollups.estimate("t", "theta").alias("t"), rollups.estimate("k", "kll").alias("n"), rollups.estimate("top", "top").alias("top")).collect()}


def test_merged_sketches_say_what_sketches_of_all_rows_say(spark, tmp_path):
    rng = random.Random(1)
    rows = [(d, rng.randrange(900), rng.gauss(0, 1)) for d in range(14) for _ in range(300)] + [(20, None, 1.0), (20, 5, None)]
    df = spark.createDataFrame(rows, "day int, u bigint, v double").repartition(6)
    week = F.floor(F.col("day") / 7).alias("week")
    path = f"{tmp_path}/daily"
    rollups.sketched(df, ["day"], KINDS).write.parquet(path)
    rolled = rollups.merged(spark.read.parquet(path), [week], KINDS)
    whole = rollups.sketched(df, [week], KINDS)
    a, b = estimates(rolled, "week"), estimates(whole, "week")
    assert {k: (v[1], v[2]) for k, v in a.items()} == {k: (v[1], v[2]) for k, v in b.items()} and len(a) == 3
    users = {w: {u for d, u, _ in rows if d // 7 == w and u is not None} for w in (0, 1, 2)}
    assert all(abs(v[0] - len(users[w])) <= rollups.HLL_ERROR * len(users[w]) + 0.5 and v[1] == len(users[w]) for (w,), v in a.items())
    late = spark.createDataFrame([(0, 5000 + i, 1.0) for i in range(50)], df.schema)  # rows of a stored day that come later
    more = rollups.merged(spark.read.parquet(path).unionByName(rollups.sketched(late, ["day"], KINDS)), ["day"], KINDS)
    day = estimates(more.where("day = 0"), "day")[0,]
    assert day[1] == len({u for d, u, _ in rows if d == 0} | set(range(5000, 5050))) and day[2] == 350


def test_merging_sketches_shuffles_sketches_only(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "day int, u bigint, v double")
    plan = rollups.sketched(df, ["day"], KINDS)._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", [7, 1, -3])
def test_count_min_estimates_read_the_sketch(spark, seed):
    rng = random.Random(seed)
    items = [rng.choice([rng.randrange(50), -rng.randrange(2**62), rng.randrange(2**62), 2**63 - 1, -(2**63)]) for _ in range(3000)]
    df = spark.createDataFrame([(i % 2, x) for i, x in enumerate(items)], "g int, x bigint")
    eps, sure = 0.02, 0.9
    made = df.groupBy("g").agg(F.count_min_sketch("x", F.lit(eps), F.lit(sure), F.lit(seed)).alias("cms"))
    depth, width = rollups.count_min_shape(eps, sure)
    factors = rollups.count_min_factors(seed, depth)
    wrap = lambda h: (h + 2**63) % 2**64 - 2**63

    def cell(a, x):
        h = wrap(a * x)
        return (wrap(h + (h >> 32)) & (2**31 - 1)) % width

    tables = defaultdict(Counter)
    for i, x in enumerate(items):
        for level, a in enumerate(factors):
            tables[i % 2, level][cell(a, x)] += 1
    probes = sorted(set(items))[:400] + [10**6 + i for i in range(50)]
    asked = spark.createDataFrame([(g, x) for g in (0, 1, 2) for x in probes], "g int, x bigint")
    got = {(r.g, r.x): r.estimate for r in rollups.count_min_estimates(asked, "x", made, "cms", ["g"]).collect()}
    want = {(g, x): min(tables[g, level][cell(a, x)] for level, a in enumerate(factors)) for g in (0, 1) for x in probes} | {(2, x): 0 for x in probes}
    assert got == want
    exact = Counter((i % 2, x) for i, x in enumerate(items))
    assert all(want[k] >= n for k, n in exact.items() if k in want)
    one = rollups.count_min_estimates(asked.where("g = 0").select("x"), "x", made.where("g = 0").select("cms"), "cms", [])
    assert {r.x: r.estimate for r in one.collect()} == {x: want[0, x] for x in probes}


def hot(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.randrange(1000))) for _ in range(6000)] + [("hot", 77.0)] * 3000 + [(None, rng.random()) for _ in range(501)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("gone", None), ("part", None), ("part", -1.5)] + [("same", 3.0)] * 100
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(7)


def test_exact_quantiles(spark):
    rows, df = hot(spark)
    shares = {"lo": 0.0, "a": 0.013, "mid": 0.5, "b": 0.9, "hi": 1.0}
    got = {r.k: r for r in ranges.exact_quantiles(df, ["k"], "v", shares).collect()}
    held = defaultdict(list)
    for k, v in rows:
        if v is not None:
            held[k].append(v)
    assert set(got) == set(held) and "gone" not in got
    for k, v in held.items():
        for name, q in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(v, q), abs=1e-9), (k, name)
    whole = ranges.exact_quantiles(df, [], "v", shares).first()
    assert whole.mid == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))
    assert ranges.exact_quantiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_quantiles_buffer_no_group(spark):
    rows, df = hot(spark)
    found = ranges.exact_quantiles(df, ["k"], "v", {"mid": 0.5})
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "median" not in plan and "collect_list(v" not in plan
    counted = df.where("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("_n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this little data would be one range
    try:
        dealt, parts = ranges._dealt(counted, ["k"], [F.col("v")], F.col("_n"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.where("_group.k = 'hot'").count() > 1  # a large group is many tasks
    assert dealt.groupBy("_range").count().agg(F.max("count")).first()[0] < dealt.count() * 0.6


def test_ranked(spark):
    rows, df = hot(spark)
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "i bigint, k string, v double").repartition(6)
    got = {r.i: r for r in ranges.ranked(df, ["k"], ["v"], ["i"]).withColumn("tile", ranges.tile(7)).collect()}
    held = defaultdict(list)
    for i, k, v in rows:
        held[k].append(((v is not None, v or 0.0), i))
    assert len(got) == len(rows)
    for k, own in held.items():
        own.sort()
        n, values = len(own), [v for v, _ in own]
        small, large = divmod(n, 7)
        first, last, kinds = {}, {}, {}
        for j, v in enumerate(values):
            first.setdefault(v, j)
            kinds.setdefault(v, len(kinds))
            last[v] = j
        for j, (v, i) in enumerate(own):
            r = got[i]
            assert (r.row_number, r["rank"], r.dense_rank, r.group_size) == (j + 1, first[v] + 1, kinds[v] + 1, n)
            assert r.cume_dist == pytest.approx((last[v] + 1) / n) and r.percent_rank == pytest.approx(first[v] / (n - 1) if n > 1 else 0.0)
            assert r.tile == (j // (small + 1) if j < large * (small + 1) else large + (j - large * (small + 1)) // max(small, 1)) + 1
    assert ranges.ranked(df.limit(0), ["k"], ["v"], ["i"]).count() == 0
