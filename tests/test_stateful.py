"""Streams with state over hand-made batches: what a batch brings, what a later one finds, and what a stop leaves."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.streaming import stateful
from tessera.streaming.queries import run_to_end, run_to_files

KIND = "event_id bigint, ts string, user_id bigint, event_type string, value double"


def files(spark, path, batches):
    for rows in batches:
        spark.createDataFrame([(i, f"2024-01-{t}:00", u, "x", 1.0) for i, t, u in rows], KIND).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(stateful._COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_sessions_go_on_over_batches_and_close_once(spark, tmp_path):
    batches = [[(1, "01 00:00", 1), (2, "01 05:00", 1), (3, "01 01:00", 2)], [(4, "01 11:00", 1), (5, "01 20:30", 2)], [(6, "01 22:00", 1)], [(7, "09 00:00", 9)], [(8, "20 00:00", 9)]]
    s = files(spark, tmp_path / "in", batches).withWatermark("ts", "0 seconds").groupBy("user_id")
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, stateful._ROCKS)
    try:
        kind = "user_id bigint, start timestamp, last timestamp, n bigint, n_kinds bigint, first_id bigint, last_id bigint"
        out = run_to_files(s.transformWithStateInPandas(stateful.Sessions(12 * 3600), kind, "append", "eventTime"), "append")
    finally:
        spark.conf.set(key, was)
    got = sorted((r.user_id, r.first_id, r.last_id, r.n) for r in out.collect())
    # user 1: 22:00 is 11 hours after 11:00, so one session over three batches; user 2: two, 19.5 hours apart; user 9's last stays open
    assert got == [(1, 1, 6, 4), (2, 3, 3, 1), (2, 5, 5, 1), (9, 7, 7, 1)]


@pytest.mark.parametrize("stops", [[0], [1, 2], [0, 1, 2, 3]])
def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path, stops):
    batches = [[(10 * b + i, f"{b + 1:02d} 0{i}:00", i % 3) for i in range(6)] for b in range(5)]
    make = lambda: files(spark, tmp_path / "in", []).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    files(spark, tmp_path / "in", batches)
    seen = []
    for stop in stops:
        with pytest.raises(StreamingQueryException):
            stateful.run_from_checkpoint(make(), "update", f"{tmp_path}/check", f"{tmp_path}/out", stop, seen.append)
    stateful.run_from_checkpoint(make(), "update", f"{tmp_path}/check", f"{tmp_path}/out", progress=seen.append)
    assert sorted(set(seen)) == list(range(5)) and all(seen.count(i) >= 2 for i in stops)  # a batch that was written but not marked runs again
    rows = spark.read.schema("user_id bigint, n bigint").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    assert {r.user_id: r.n for r in rows.groupBy("user_id").agg(F.max("n").alias("n")).collect()} == {0: 10, 1: 10, 2: 10}
    assert rows.count() == 15  # a row for each user and batch, none twice


def test_slices_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], stateful._COLUMNS)
    stateful.slices(none, f"{tmp_path}/in", 3, ("end",))
    assert [r.event_type for r in spark.read.parquet(f"{tmp_path}/in").collect()] == ["end"]


def test_rows_behind_the_watermark_are_dropped_and_reported(spark, tmp_path):
    s = files(spark, tmp_path / "in", [[(1, "01 00:00", 1), (2, "02 00:00", 1)], [(3, "10 00:00", 1)], [(4, "01 00:30", 1)], [(5, "28 00:00", 1)]])
    reports = []
    counted = run_to_end(s.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select("window.start", "n"), "append", reports)
    assert counted.agg(F.sum("n")).first()[0] == 3  # the last window stays open
    assert sum(op["numRowsDroppedByWatermark"] for r in reports for op in r["stateOperators"]) == 1


def test_a_repeat_passes_once_its_key_is_forgotten(spark, tmp_path):
    s = files(spark, tmp_path / "in", [[(1, "01 00:00", 1), (2, "01 00:01", 1), (3, "01 00:10", 2)], [(4, "01 00:20", 1)], [(5, "03 00:00", 9)], [(6, "03 00:01", 9)], [(7, "03 00:30", 1)]])
    once = run_to_end(s.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["user_id"]).select("user_id", "event_id"), "append")
    got = sorted((r.user_id, r.event_id) for r in once.where("user_id < 9").collect())
    assert [u for u, _ in got] == [1, 1, 2] and got[1][1] == 7 and got[2] == (2, 3)
