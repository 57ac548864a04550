"""What depends on the order in which rows arrive, and on state that is to be gone in time: on hand-made tables."""

from datetime import datetime, timedelta

import duckdb
from compare import SF, rows

from tessera.plans import catalog


def tables(spark, path, **made):
    """A folder with the given tables, for the query and for its SQL."""
    for name, (data, kind) in made.items():
        spark.createDataFrame(data, kind).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def want(path, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return rows(con.execute(catalog.ORACLES[name]).df())


def test_a_customers_largest_orders_are_numbered_by_price(spark):
    plan = catalog.QUERIES["lateral_join"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(o_custkey" in plan
    for line in plan.splitlines():
        if "row_number() windowspecdefinition" in line:
            assert "o_totalprice" in line.split("specifiedwindowframe")[0] and "o_orderkey" in line.split("specifiedwindowframe")[0]


def test_users_of_a_slices_last_hours_are_forgotten_too(spark, tmp_path):
    start, kind = datetime(2024, 1, 1), "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    # user 2 comes in the last minutes of a slice only; the slices of 120 days later lie behind a tick a hundred days after the start
    hours = [(0, 1), (143.5, 2), (143.9, 3), (145, 2), (150, 3), (287.9, 2), (300, 1), (300, 2), (20 * 144 + 1, 1), (21 * 144 - 0.2, 2), (21 * 144 + 1, 2), (21 * 144 + 2, 1)]
    path = tables(spark, tmp_path, events=([(i, start + timedelta(hours=h), u, "view", 1.0, "") for i, (h, u) in enumerate(hours)], kind))
    got = rows(catalog.QUERIES["dedup_state_expires"](spark, path).toPandas())
    assert got == want(path, "dedup_state_expires", "events")
    assert got == [("2", "3"), ("4", "1"), ("5", "2")]
