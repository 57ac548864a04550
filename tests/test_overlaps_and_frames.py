"""Overlap joins, EXCLUDE frames, buckets and table arguments on hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.udfs import Runs
from tessera.operators.relational import bucketed, overlap_join
from tessera.operators.windows import excluding


def spans(rng, n, wide):
    rows = [(i, x := rng.uniform(-50, 50), x + rng.choice([0.1, 1, 5])) for i in range(n)]
    return rows + [(n, -1e6, 1e6), (n + 1, 3.0, 3.0), (n + 2, 5.0, 4.0), (n + 3, None, 4.0), (n + 4, 4.0, None), (n + 5, 8.0, 16.0), (n + 6, 16.0, 24.0), (n + 7, -8.0, 0.0)] + [(n + 8 + i, 0.0, 1e-3) for i in range(wide)]


def test_overlap_join(spark):
    rng = random.Random(1)
    a, b = spans(rng, 200, 30), spans(rng, 150, 40)
    left = spark.createDataFrame(a, "i int, al double, ah double").repartition(3)
    right = spark.createDataFrame(b, "j int, bl double, bh double").repartition(4)
    found = overlap_join(left, right, ("al", "ah"), ("bl", "bh"), 0.5)
    sound = lambda rows: [r for r in rows if None not in r and r[1] < r[2]]
    want = sorted((i, j) for i, al, ah in sound(a) for j, bl, bh in sound(b) if al < bh and bl < ah)
    assert sorted((r.i, r.j) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # the widest span is a few rows at each level, not one for each bucket of the finest
    assert overlap_join(left.where("i = 200"), right.where("j >= 150"), ("al", "ah"), ("bl", "bh"), 0.5).count() == len([r for r in sound(b) if r[0] >= 150])
    assert overlap_join(left.limit(0), right, ("al", "ah"), ("bl", "bh"), 0.5).count() == 0


@pytest.mark.parametrize("unit", ["ROWS", "GROUPS"])
@pytest.mark.parametrize("exclude", ["CURRENT ROW", "GROUP", "TIES", "NO OTHERS"])
def test_excluding(spark, unit, exclude):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([None, rng.random()])) for i in range(120)]
    df = spark.createDataFrame(rows, "t int, p string, o int, v double").repartition(4)
    got = {r.t: (r.n, r.least, r.most) for r in excluding(df, "v", "p", "o", "t", unit, 2, 1, exclude).collect()}
    for p in "ab":
        own = sorted((r for r in rows if r[1] == p), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        kinds = sorted({r[2] for r in own}, key=lambda x: (x is not None, x or 0))
        for k, r in enumerate(own):
            g = kinds.index(r[2])
            near = own[max(0, k - 2) : k + 2] if unit == "ROWS" else [x for x in own if g - 2 <= kinds.index(x[2]) <= g + 1]
            gone = {"CURRENT ROW": lambda x: x is r, "GROUP": lambda x: x[2] == r[2], "TIES": lambda x: x[2] == r[2] and x is not r, "NO OTHERS": lambda x: False}[exclude]
            kept = [x[3] for x in near if not gone(x) and x[3] is not None]
            assert got[r[0]] == (len(kept), min(kept, default=None), max(kept, default=None)), (unit, exclude, r)


def test_buckets_need_no_exchange(spark):
    rng = random.Random(3)
    a = spark.createDataFrame([(rng.randrange(50), i) for i in range(500)], "k int, x int")
    b = spark.createDataFrame([(rng.randrange(50), i) for i in range(300)], "k2 int, y int")
    left, right = bucketed(a, "bucketed_a", "k", 4), bucketed(b, "bucketed_b", "k2", 4)
    joined = left.hint("merge").join(right, F.col("k") == F.col("k2")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, F.col("k") == F.col("k2")).groupBy("k").count().collect()))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_a")
    spark.sql("DROP TABLE bucketed_b")


def test_runs_of_a_table_argument(spark):
    spark.udtf.register("runs_of", F.udtf(Runs))
    spark.createDataFrame([("u", 1, "a"), ("u", 3, "b"), ("u", 2, "a"), ("u", 4, None), ("u", 5, None), ("w", 1, "a"), (None, 1, "z"), (None, 2, "z")], "who string, at int, what string").repartition(3).createOrReplaceTempView("seen")
    got = spark.sql("SELECT * FROM runs_of(TABLE(seen) PARTITION BY who ORDER BY at)")
    assert got.columns == ["who", "what", "run_start", "n"]  # from the table's columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("u", "a", 1, 2), ("u", "b", 3, 1), ("u", None, 4, 2), ("w", "a", 1, 1), (None, "z", 1, 2)]))
    assert spark.sql("SELECT * FROM runs_of(TABLE(SELECT * FROM seen WHERE at > 9) PARTITION BY who ORDER BY at)").count() == 0
