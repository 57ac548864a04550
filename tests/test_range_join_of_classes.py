"""Ranges that many rows share: each point is held against a range once."""

from pyspark.sql import functions as F

from tessera.operators import relational


def test_equal_ranges_are_met_as_one(spark):
    rng = __import__("random").Random(7)
    a = spark.createDataFrame([(i, rng.choice([None, float(rng.randrange(12)), rng.uniform(-3, 12)])) for i in range(400)], "a int, x double")
    b = spark.createDataFrame([(i if i % 50 else None, lo, lo + rng.choice([2.0, 2.0, 0.0, 7.0])) for i, lo in enumerate(float(rng.randrange(8)) for _ in range(300))] + [(900, None, 4.0)], "b long, lo double, hi double")
    got = relational.range_join_of_classes(a, b, "x", "lo", "hi", 2.0, "b").select("a", "b", "lo", "hi")
    want = a.join(b, (F.col("lo") <= F.col("x")) & (F.col("x") < F.col("hi"))).select("a", "b", "lo", "hi")
    assert got.count() == want.count() > 1000 and got.exceptAll(want).count() == 0 and want.where("b IS NULL").count() > 0
    assert relational.range_join_of_classes(a, b.limit(0), "x", "lo", "hi", 2.0, "b").count() == 0


def test_a_join_of_few_sizes_is_no_join_of_all_parts(spark):
    from compare import SF

    from tessera.plans import catalog

    found = catalog.QUERIES["theta_range_join_all_parts"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(p_partkey" in plan and plan.index("Generate explode(_keys") < plan.index("Join Inner")
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1
