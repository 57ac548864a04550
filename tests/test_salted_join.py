"""Only hot keys are repeated by the salted join, and neither side is sent to the driver."""

from pyspark.sql import functions as F

from tessera.operators import relational


def test_salted_join_repeats_hot_keys_only(spark):
    big = spark.range(6000).select(F.when(F.col("id") % 4 == 0, -1).otherwise(F.when(F.col("id") % 7 == 1, None).otherwise(F.col("id"))).alias("k"), "id")
    small = spark.range(-1, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).union(spark.range(-1, 0).select("id", F.lit(5).cast("long")))
    a, b = relational.salted(big, small, "k", 8)
    assert a.where("k = -1").select("_salt").distinct().count() == 8 and a.where("k <> -1 OR k IS NULL").select("_salt").distinct().count() == 1
    assert b.count() == small.count() + 7 * 2  # the hot key's two rows, eight times each
    x, y = (j.select("k", "id", "w") for j in (relational.salted_join(big, small, "k", 8), big.join(small, "k")))
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0 and x.count() > 3000
    assert relational.salted_join(big.limit(0), small, "k").count() == 0


def test_salted_join_is_not_broadcast(spark):
    big, small = spark.range(5000).select(F.col("id").alias("k"), "id"), spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("w"))
    found = relational.salted_join(big, small, "k")
    assert found.count() == 1000
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
