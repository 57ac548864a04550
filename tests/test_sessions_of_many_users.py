"""Sessions by timers where a key stands for many users."""

import random

from pyspark.sql import functions as F

from tessera.streaming import stateful
from tessera.streaming.queries import run_to_files

GAP = 12 * 3600


def test_sessions_of_users_that_share_a_key(spark, tmp_path):
    rng, rows = random.Random(6), []
    for user in range(12):
        t = rng.randrange(100_000)
        while t < 5 * 86400:
            rows.append((len(rows), t, user, rng.choice(["a", "b", "c", None])))
            t += rng.choice([0, 3_000, GAP - 1, GAP, GAP + 1, 70_000])
    kind = "event_id bigint, ts long, user_id bigint, event_type string"
    for i in range(5):  # one day each, then a row of long after
        day = [r for r in rows if r[1] // 86400 == i]
        rng.shuffle(day)
        spark.createDataFrame(day, kind).select("event_id", F.timestamp_seconds("ts").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(-1, 9**9, -1, "end")], kind).select("event_id", F.timestamp_seconds("ts").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(stateful._COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds").withColumn("users", F.pmod("user_id", F.lit(3))).groupBy("users")
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, stateful._ROCKS)
    try:
        out = run_to_files(s.transformWithStateInPandas(stateful.Sessions(GAP), "user_id bigint, start timestamp, last timestamp, n bigint, n_kinds bigint, first_id bigint, last_id bigint", "append", "eventTime"), "append")
    finally:
        spark.conf.set(key, was)
    want = []
    for user in range(12):
        run = []
        for r in sorted(((r[1], r[0], r[3]) for r in rows if r[2] == user), key=lambda r: r[:2]):
            if run and r[0] - run[-1][0] >= GAP:
                want.append((user, run))
                run = []
            run.append(r)
        want.append((user, run))
    want = sorted((u, run[0][0], run[-1][0], len(run), len({k for _, _, k in run} - {None}), run[0][1], run[-1][1]) for u, run in want)
    found = out.where("user_id >= 0").select("user_id", F.unix_seconds("start"), F.unix_seconds("last"), "n", "n_kinds", "first_id", "last_id")
    assert sorted(map(tuple, found.collect())) == want
