"""Structured Streaming: each query runs over the events to its end and returns what its sink holds.

Watermarks don't take timestamp_ntz, so event time is cast to timestamp (the session's zone is UTC). In append
mode the last windows stay open until a later event comes, so a stream that is to close them all ends with a
sentinel event of a later time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.registry import load, query, scratch

_SENTINEL = "2030-01-01 00:00:00"


def run_to_end(stream: DataFrame, mode: str, progress: list | None = None) -> DataFrame:
    """Runs a stream over all that its source has, then returns the rows of its sink (for results of a known small size).

    progress: gets the reports of the batches.
    """
    name = f"sink_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", scratch(stream.sparkSession)).start()
    try:
        q.processAllAvailable()
        if progress is not None:
            progress += q.recentProgress
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, mode: str, progress: list | None = None) -> DataFrame:
    """Runs a stream over all that its source has into files of the shared folder, and returns what they hold.

    For results that grow with the input: no row goes through the driver. A batch that is run again overwrites its own
    folder, as the file sink takes the append mode alone. progress: gets the reports of the batches.
    """
    spark, out = stream.sparkSession, scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark))
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=none")
        q = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    try:
        q.processAllAvailable()
        if progress is not None:
            progress += q.recentProgress
    finally:
        q.stop()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", str(mode != "append").lower()).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str, sentinel: bool = False) -> DataFrame:
    """The events as a stream of files, with event time as timestamp."""
    events = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    path = scratch(spark)
    events.write.parquet(path)
    if sentinel:
        late = spark.createDataFrame([(-1, _SENTINEL, -1, "end", 0.0)], "event_id bigint, t string, user_id bigint, event_type string, value double")
        late.select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value").write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


_DAY = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2"


@query(_DAY)
def tumbling_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(_DAY)
def tumbling_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return run_to_end(s.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "complete")


@query("SELECT s AS start, count(*)::BIGINT AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    """SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM (
    SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g"""
)
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = load(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY 1")
def watermark_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stream(spark, sf_dir, sentinel=True).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    out = run_to_end(s.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "append")
    return out.where(F.col("start") < F.lit(_SENTINEL).cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stream(spark, sf_dir).withWatermark("ts", "400 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return run_to_files(s.select("user_id", "event_type"), "append")


@query("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return run_to_files(event_stream(spark, sf_dir).join(people, "user_id").select("event_id", "c_mktsegment"), "append")


@query("SELECT a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = event_stream(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("ts").alias("ta")).withWatermark("ta", "1 day")
    b = event_stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", F.col("ts").alias("tb")).withWatermark("tb", "1 day")
    both = a.join(b, (F.col("u") == F.col("user_id")) & (F.col("tb") >= F.col("ta")) & (F.col("tb") <= F.col("ta") + F.expr("INTERVAL 6 HOURS")))
    return run_to_files(both.select("click_id", "buy_id"), "append")


@query("SELECT user_id, count(*)::BIGINT AS n, ROUND(sum(value), 4) AS total FROM events GROUP BY user_id")
def stateful_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    s = event_stream(spark, sf_dir).groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)
    return run_to_files(s, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


class Counter(StatefulProcessor):
    """Counts the rows of each key over the life of the stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.n.get()[0] if self.n.exists() else 0
        n += sum(len(p) for p in rows)
        self.n.update((n,))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def transform_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = event_stream(spark, sf_dir).groupBy("event_type").transformWithStateInPandas(Counter(), "event_type string, n bigint", "update", "none")
        return run_to_end(s, "update").groupBy("event_type").agg(F.max("n").alias("n"))
    finally:
        spark.conf.set(key, was)
