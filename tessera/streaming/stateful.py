"""Streams that end sessions and report silence by event time, wait for the other side of a join, and go on after a stop.

The events come in slices of time, one file and batch each, so that state, timers and watermarks carry over batches. A
last event of a far later time (the sentinel) pushes the watermark past all others, so that everything closes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.registry import load, query, scratch
from .queries import _SENTINEL, run_to_files

_COLUMNS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def slices(events: DataFrame, path: str, n: int, sentinel: tuple[str, ...] = ()) -> None:
    """Writes events to path as n files, one a slice of time, the oldest first; then a sentinel of each given event type."""
    bounds = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if bounds[0] is not None:
        slot = F.least(F.lit(n - 1), F.floor((F.unix_micros("ts") - bounds[0]) * n / F.lit(bounds[1] - bounds[0] + 1)))
        for i in range(n):
            events.where(slot == i).coalesce(1).write.mode("append").parquet(path)
    spark = events.sparkSession
    rows = [(-1 - i, _SENTINEL, -1, kind, 0.0) for i, kind in enumerate(sentinel)]
    if rows:
        late = spark.createDataFrame(rows, _COLUMNS.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        late.coalesce(1).write.mode("append").parquet(path)


def sliced_stream(spark: SparkSession, sf_dir: str, n: int = 4, sentinel: tuple[str, ...] = ("end",)) -> DataFrame:
    path = scratch(spark)
    slices(_events(spark, sf_dir), path, n, sentinel)
    return spark.readStream.schema(_COLUMNS).option("maxFilesPerTrigger", 1).parquet(path)


# -- sessions by timers -------------------------------------------------------------------------------------


class Sessions(StatefulProcessor):
    """Sessions of users: rows less than a gap apart. Each is handed on once, when a timer says that no more can come.

    A key stands for any number of users, whose rows of a batch are taken together, as columns: a call to the state costs
    as much as a hundred rows, and here there are a few for each key and batch. State: the open sessions, one a user at
    most (list), and the time in milliseconds at which the first of them can end (value), which is the key's one timer. A
    row that comes after the gap closes the session before it at once, else the watermark does.
    """

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 10**6  # all times in microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "user_id bigint, start bigint, last bigint, n bigint, first_id bigint, last_id bigint, kinds array<string>")
        self.timer = handle.getValueState("timer", "at bigint")

    _FIELDS = ("user_id", "start", "last", "n", "first_id", "last_id", "kinds")

    def _keep(self, still: pd.DataFrame) -> None:
        """Puts the open sessions in place of those before, and the timer at the first time at which one can end."""
        was = self.timer.get()[0] if self.timer.exists() else None
        at = -(-(int(still["last"].min()) + self.gap) // 1000) if len(still) else None  # rounded up
        if was is not None and at != was:
            self.handle.deleteTimer(was)
        if at is None:
            self.open.clear()
            self.timer.clear()
            return
        columns = [still[c].tolist() for c in self._FIELDS]
        self.open.put(list(zip(*columns)))
        if at != was:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    @staticmethod
    def _out(closed: pd.DataFrame) -> pd.DataFrame:
        at = lambda c: pd.to_datetime(closed[c], unit="us")
        return closed[["user_id"]].assign(start=at("start"), last=at("last"), n=closed["n"], n_kinds=closed["kinds"].map(len), first_id=closed["first_id"], last_id=closed["last_id"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        us = new["ts"].astype("datetime64[us]").astype("int64")
        parts = pd.DataFrame({"user_id": new["user_id"], "start": us, "last": us, "n": 1, "first_id": new["event_id"], "last_id": new["event_id"], "kinds": new["event_type"].map(lambda k: () if k is None else (k,))})
        if self.open.exists():
            held = pd.DataFrame([tuple(x) for x in self.open.get()], columns=self._FIELDS)
            parts = pd.concat([held, parts], ignore_index=True)
        parts = parts.sort_values(["user_id", "start", "first_id"], ignore_index=True)
        # apart from all before it of its user by the gap
        before = parts.groupby("user_id")["last"].cummax().shift(fill_value=0)
        other = parts["user_id"] != parts["user_id"].shift()
        parts["session"] = (other | (parts["start"] - before >= self.gap)).cumsum()
        by = parts.groupby("session")
        found = by.agg(user_id=("user_id", "first"), start=("start", "min"), last=("last", "max"), n=("n", "sum"), first_id=("first_id", "first"))
        found["last_id"] = parts.sort_values(["session", "last", "last_id"]).groupby("session")["last_id"].last()
        kinds: dict[int, set] = {}
        for session, own in zip(parts["session"].tolist(), parts["kinds"].tolist()):
            kinds.setdefault(session, set()).update(own)
        found["kinds"] = [sorted(kinds[x]) for x in found.index]
        ends = found["user_id"] == found["user_id"].shift(-1)  # a later session of the same user follows
        self._keep(found[~ends])
        if ends.any():
            yield self._out(found[ends])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.open.exists():
            return
        held = pd.DataFrame([tuple(x) for x in self.open.get()], columns=self._FIELDS)
        over = held["last"] + self.gap <= timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(held[~over])
        if over.any():
            yield self._out(held[over])

    def close(self) -> None:
        pass


#: Keys that users are dealt over, each with the open sessions of its users.
_GROUPS = 1024

_ISLANDS = """SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)"""


@query(f"SELECT user_id, min(ts) AS start, max(ts) AS last, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS n_kinds, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM ({_ISLANDS}) GROUP BY user_id, g")
def sessions_by_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users closed by event-time timers, across batches."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, _ROCKS)
    try:
        s = sliced_stream(spark, sf_dir).where("user_id IS NOT NULL").withWatermark("ts", "0 seconds")
        s = s.withColumn("users", F.pmod(F.xxhash64("user_id"), F.lit(_GROUPS))).groupBy("users")
        kind = "user_id bigint, start timestamp, last timestamp, n bigint, n_kinds bigint, first_id bigint, last_id bigint"
        out = run_to_files(s.transformWithStateInPandas(Sessions(12 * 3600), kind, "append", "eventTime"), "append")
    finally:
        spark.conf.set(key, was)
    return out.where("user_id >= 0").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


@query(
    """SELECT user_id, min(ts) AS start, max(until) AS until, count(*)::BIGINT AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
    SELECT *, CASE WHEN ts <= max(until) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (
    SELECT *, ts + CASE WHEN event_type = 'purchase' THEN INTERVAL 2 HOUR WHEN event_type = 'click' THEN INTERVAL 20 HOUR ELSE INTERVAL 8 HOUR END AS until FROM events))) GROUP BY user_id, g"""
)
def session_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions under a watermark, in append mode, whose gap depends on the row: a purchase ends soon, a click keeps its session open long."""
    gap = F.when(F.col("event_type") == "purchase", "2 hours").when(F.col("event_type") == "click", "20 hours").otherwise("8 hours")
    s = sliced_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    at = lambda c: F.col(f"session_window.{c}").cast("timestamp_ntz")
    return run_to_files(s.select("user_id", at("start").alias("start"), at("end").alias("until"), "n"), "append").where("user_id >= 0")


# -- joins that wait ----------------------------------------------------------------------------------------


@query("SELECT a.event_id AS click_id, b.event_id AS buy_id FROM (SELECT * FROM events WHERE event_type = 'click') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def stream_stream_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of the next six hours; a click without one comes with null, once the watermark says that none can come."""
    side = lambda kind: sliced_stream(spark, sf_dir, sentinel=(kind,)).where(F.col("event_type") == kind)
    a = side("click").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("ts").alias("ta")).withWatermark("ta", "1 hour")
    b = side("purchase").select(F.col("event_id").alias("buy_id"), "user_id", F.col("ts").alias("tb")).withWatermark("tb", "1 hour")
    on = (F.col("u") == F.col("user_id")) & (F.col("tb") >= F.col("ta")) & (F.col("tb") <= F.col("ta") + F.expr("INTERVAL 6 HOURS"))
    return run_to_files(a.join(b, on, "left").select("click_id", "buy_id"), "append").where("click_id >= 0")


# -- silence by timeouts ------------------------------------------------------------------------------------


@query("SELECT user_id, event_id AS last_id, ts AS last FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR next - ts >= INTERVAL 36 HOUR")
def idle_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each silence of 36 hours or more of a user, reported once by an event-time timeout that also removes the user's state."""
    gap = pd.Timedelta(hours=36)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = (state.get[0], pd.Timestamp(state.get[1])) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(last)
            state.remove()
        else:
            for r in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():
                if last is not None and r.ts - last[1] >= gap:
                    out.append(last)
                last = (r.event_id, r.ts)
            state.update((last[0], last[1].to_pydatetime()))
            state.setTimeoutTimestamp(-(-((last[1] + gap).value) // 10**6))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "last_id": [o[0] for o in out], "last": [o[1] for o in out]}).astype({"user_id": "int64", "last_id": "int64", "last": "datetime64[us]"})

    s = sliced_stream(spark, sf_dir).withWatermark("ts", "0 seconds").groupBy("user_id")
    out = s.applyInPandasWithState(step, "user_id bigint, last_id bigint, last timestamp", "id bigint, last timestamp", "append", GroupStateTimeout.EventTimeTimeout)
    return run_to_files(out, "append").where("user_id >= 0").withColumn("last", F.col("last").cast("timestamp_ntz"))


# -- restart ------------------------------------------------------------------------------------------------


class Stopped(RuntimeError):
    """Ends a run on purpose."""


def run_from_checkpoint(stream: DataFrame, mode: str, checkpoint: str, out: str, stop_after: int | None = None, progress: Callable[[int], None] | None = None) -> None:
    """Runs a stream over what its source has, from where the checkpoint says; each batch overwrites a folder of its own below `out`.

    The offset log and the state make a later call with the same checkpoint go on where this one ended, and a batch that
    was written but not marked as done is run again, into the same folder: no row is lost or doubled. stop_after: fails
    in the batch of this number, after it is written and before it is marked.
    """

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
        if progress:
            progress(i)
        if stop_after is not None and i >= stop_after:
            raise Stopped(f"after batch {i}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


@query("SELECT user_id, count(*)::BIGINT AS n, ROUND(sum(value), 4) AS total, count(*)::BIGINT AS n_rows FROM events GROUP BY user_id")
def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums by user over a stream that fails after its second batch is written, starts again, ends, and goes on when more files come.

    n and total are the last running sums of each user (the state lived through the stop); n_rows counts the rows that a
    second, stateless stream wrote through the same stops (none lost or doubled).
    """
    source, events = scratch(spark), _events(spark, sf_dir)
    half = events.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)")).first()[0] or 0
    first = F.unix_micros("ts") <= half
    slices(events.where(first), source, 3)
    stream = lambda: spark.readStream.schema(_COLUMNS).option("maxFilesPerTrigger", 1).parquet(source)
    summed = lambda: stream().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    runs = [(summed, "update", scratch(spark), scratch(spark)), (lambda: stream().select("user_id", "event_id"), "append", scratch(spark), scratch(spark))]
    for make, mode, checkpoint, out in runs:
        try:
            run_from_checkpoint(make(), mode, checkpoint, out, stop_after=1)
        except StreamingQueryException as e:
            if "after batch" not in str(e):
                raise
        run_from_checkpoint(make(), mode, checkpoint, out)
    slices(events.where(~first), source, 2)
    for make, mode, checkpoint, out in runs:
        run_from_checkpoint(make(), mode, checkpoint, out)
    sums, rows = (spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(out) for kind, (_, _, _, out) in zip(("user_id bigint, n bigint, total double", "user_id bigint, event_id bigint"), runs))
    last = sums.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))
    return last.join(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows")), "user_id")


# -- rows behind the watermark ------------------------------------------------------------------------------


@query("SELECT count(*)::BIGINT AS n_kept, count(*) FILTER (WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 1 DAY)::BIGINT AS n_dropped FROM events")
def late_data_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the first day come again at the end: behind the watermark, they aren't counted, and the stream's reports say how many were dropped."""
    path, events = scratch(spark), _events(spark, sf_dir)
    slices(events, path, 3)
    again = events.where(F.col("ts") < F.lit(events.agg(F.min("ts")).first()[0]) + F.expr("INTERVAL 1 DAY"))
    again.coalesce(1).write.mode("append").parquet(path)
    slices(events.limit(0), path, 1, ("end",))
    s, reports = spark.readStream.schema(_COLUMNS).option("maxFilesPerTrigger", 1).parquet(path), []
    # by event, so that no row is summed before the watermark is held against it
    counted = s.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_id").agg(F.count(F.lit(1)).alias("n")).select("event_id", "n")
    kept = run_to_files(counted, "append", reports)  # a row for each event
    dropped = sum(op["numRowsDroppedByWatermark"] for r in reports for op in r["stateOperators"])
    return kept.where("event_id >= 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_kept"), F.lit(dropped).cast("bigint").alias("n_dropped"))


@query(
    """SELECT user_id, (count(*) + 1)::BIGINT AS n FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM (SELECT min(ts) AS ts, user_id, time_bucket(INTERVAL 6 DAY, ts, (SELECT min(ts) FROM events)) AS slice FROM events GROUP BY ALL)) WHERE prev IS NOT NULL GROUP BY user_id
    UNION ALL SELECT user_id, 1::BIGINT FROM (SELECT user_id FROM (SELECT DISTINCT user_id, time_bucket(INTERVAL 6 DAY, ts, (SELECT min(ts) FROM events)) AS slice FROM events) GROUP BY user_id HAVING count(*) = 1)"""
)
def dedup_state_expires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is let through once while remembered. Slices of six days are moved a year apart, so each slice lets a user through once again.

    State goes at the end of a batch, by the watermark of the batch before. So each slice's batch ends with a row (a tick)
    of long after it, and another batch stands between it and the next slice: there all of its users are forgotten.
    """
    path, events = scratch(spark), _events(spark, sf_dir)
    start = events.agg(F.min("ts")).first()[0]
    slot = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(start))) / F.lit(6 * 86400 * 10**6))
    for i in sorted(r[0] for r in events.select(slot).distinct().collect() if r[0] is not None) or [0]:
        moved = events.where(slot == i).withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(365 * i)))
        at = F.lit(start).cast("timestamp") + F.make_dt_interval(F.lit((365 + 6) * i + 100))
        tick = spark.createDataFrame([(-1 - i, -1, "tick", 0.0)], "event_id bigint, user_id bigint, event_type string, value double").withColumn("ts", at).select(*moved.columns)
        moved.union(tick).coalesce(1).write.mode("append").parquet(path)
        tick.coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(_COLUMNS).option("maxFilesPerTrigger", 1).parquet(path)
    once = s.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["user_id"])
    return run_to_files(once.select("user_id", "event_id"), "append").where("user_id >= 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
