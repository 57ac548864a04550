"""Operators composed here, on small frames with what the tables lack: nulls, ties, empty sides, hot keys."""

from pyspark.sql import functions as F

from tessera.operators import relational, windows


def test_range_join_with_edges_and_nulls(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 4.0), (3, -3.5), (4, None), (5, 9.99)], "a int, x double")
    b = spark.createDataFrame([(1, 0.0, 4.0), (2, 4.0, 4.0), (3, -4.0, 10.0), (4, None, 3.0)], "b int, lo double, hi double")
    got = {(r.a, r.b) for r in relational.range_join(a, b, "x", "lo", "hi", 2.5).collect()}
    assert got == {(1, 1), (1, 3), (2, 3), (3, 3), (5, 3)}
    assert relational.range_join(a.limit(0), b, "x", "lo", "hi", 2.5).count() == 0


def test_range_join_of_wide_intervals_meets_few_buckets(spark):
    rng = __import__("random").Random(4)
    a = spark.createDataFrame([(i, rng.uniform(-50, 1e6)) for i in range(300)], "a int, x double")
    b = spark.createDataFrame([(i, lo, lo + rng.choice([0.5, 3.0, 1e4, 9e5])) for i, lo in enumerate(rng.uniform(-100, 9e5) for _ in range(100))], "b int, lo double, hi double")
    want = {(r.a, r.b) for r in a.join(b, (F.col("lo") <= F.col("x")) & (F.col("x") < F.col("hi"))).collect()}
    got = relational.range_join(a, b, "x", "lo", "hi", 1.0)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_asof_join_carries_over_spans(spark):
    rng = __import__("random").Random(5)
    a = spark.createDataFrame([(rng.choice("abc"), rng.randrange(0, 20_000), i) for i in range(400)] + [(None, 5, 900), ("a", None, 901)], "k string, t int, l int")
    b = spark.createDataFrame([(k, t, t * 2) for k in "ab" for t in rng.sample(range(20_000), 25)] + [("c", 15_500, None)], "k string, t int, v int")
    rights = [tuple(r) for r in b.collect()]
    got = {r.l: r.v for r in relational.asof_join(a, b, "t", "k", ["v"]).collect()}
    for r in a.where("t IS NOT NULL AND k IS NOT NULL").collect():
        before = [x for x in rights if x[0] == r.k and x[1] <= r.t]
        assert got[r.l] == (max(before, key=lambda x: x[1])[2] if before else None)
    assert len(got) == 402


def test_asof_join_takes_last_at_or_before(spark):
    a = spark.createDataFrame([("k", 5, "a"), ("k", 1, "b"), ("z", 5, "c"), ("k", 3, "d")], "k string, t int, l string")
    b = spark.createDataFrame([("k", 3, 30), ("k", 5, None), ("k", 4, 40)], "k string, t int, v int")
    got = {r.l: r.v for r in relational.asof_join(a, b, "t", "k", ["v"]).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": 30}


def test_salted_join_equals_plain_join(spark):
    a = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    b = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    x = relational.salted_join(a, b, "k").select("k", "id", "w")
    y = a.join(b, "k").select("k", "id", "w")
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_groups_frame_counts_peers(spark):
    df = spark.createDataFrame([("p", 1), ("p", 1), ("p", 2), ("p", 9)], "p string, o int")
    got = sorted((r.o, r.n) for r in windows.over_groups(df, F.count(F.lit(1)), "p", "o", 1, 0, "n").collect())
    assert got == [(1, 2), (1, 2), (2, 3), (9, 2)]


def test_plan_pushes_filters_and_prunes_columns(spark):
    from compare import SF

    plan = relational.project_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_tax" not in plan


def test_whole_tables_are_covered(spark):
    from compare import SF

    from tessera.functions import scalar  # noqa: F401
    from tessera.plans import catalog

    run = lambda name: catalog.QUERIES[name](spark, SF)
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    assert run("math_functions_all_rows").count() == table("lineitem").count() == run("math_functions").count()
    for name in ("array_explode", "array_explode_all_rows"):
        assert run(name).select("vec_id").distinct().count() == table("embeddings").select("vec_id").distinct().count() > 20
    pairs = table("events").join(table("part"), (F.col("value") >= F.col("p_size")) & (F.col("value") < F.col("p_size") + 2)).select("event_id", "p_partkey")
    got = run("theta_range_join_all_parts")
    assert got.count() == pairs.count() and got.exceptAll(pairs).count() == 0 and got.where("p_partkey >= 100").count() > 0
    low = F.col("p_size") + (F.col("p_partkey") % 1000) / F.lit(1000.0)
    pairs = table("events").join(table("part").withColumn("lo", low), (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("lo") + 0.0005)).select("event_id", "p_partkey")
    got = run("theta_range_join")
    assert got.count() == pairs.count() > 0 and got.exceptAll(pairs).count() == 0


def test_whole_texts_sorts_and_groups(spark):
    from compare import SF, connect

    from tessera.plans import catalog

    run = lambda name: catalog.QUERIES[name](spark, SF).collect()
    for name in ("regex_functions_whole_text", "regex_functions"):
        assert max(len(r.masked or "") for r in run(name)) > 60
    for name, last in (("sort_nulls_all_rows", True), ("sort_nulls", False)):
        got = [tuple(r) for r in run(name)]
        assert got == connect().execute(catalog.ORACLES[name]).fetchall()
        nulls = [nk is None for _, nk in got]
        assert nulls == sorted(nulls, reverse=not last) and (any(nulls) or not last)
    for name, table, key in (("mode_of_all_groups", "customer", "c_nationkey"), ("mode_of", "orders", "o_custkey")):
        assert len(run(name)) == connect().execute(f"SELECT count(DISTINCT {key}) FROM {table}").fetchone()[0]


def test_a_sample_has_its_size_and_comes_again(spark):
    from compare import SF

    from tessera.plans import catalog

    run = lambda: sorted(r.o_orderkey for r in catalog.QUERIES["table_sample"](spark, SF).collect())
    keys, n = run(), spark.read.parquet(f"{SF}/orders.parquet").count()
    assert 0.06 * n < len(keys) < 0.14 * n and keys == run()


def test_hashes_are_those_of_other_programs(spark):
    import zlib

    import xxhash
    from compare import SF

    from tessera.plans import catalog

    names = {r.c_custkey: r.c_name.encode() for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_name").collect()}
    got = catalog.QUERIES["hash_functions_native"](spark, SF).collect()
    assert len(got) == len(names)
    for r in got:
        assert r.crc == zlib.crc32(names[r.c_custkey]) and r.bit1 == r.c_custkey >> 1 & 1
        assert r.xx % 2**64 == xxhash.xxh64_intdigest(names[r.c_custkey], 42)


def test_set_operations_leave_rows(spark):
    from compare import SF

    from tessera.plans import catalog

    for name in ("union_op", "union_all_op", "intersect_op", "intersect_all_op", "except_op", "except_all_op"):
        assert catalog.QUERIES[name](spark, SF).count() > 0, name


def test_streams_that_grow_end_in_files(spark):
    from compare import SF

    from tessera.plans import catalog

    for name in ("stream_static_join", "stream_stream_join", "dedup_within_watermark", "stateful_pandas"):
        found = catalog.QUERIES[name](spark, SF)
        assert found.inputFiles() and found.count() > 0, name
