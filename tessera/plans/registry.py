"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..ship import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that DuckDB is to agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers SQL over the tables, which Spark reads as temporary views; oracle: where DuckDB needs other words."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                load(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or text


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names; only a local session may go without, in a temporary one."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
