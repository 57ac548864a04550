"""The user-defined function surface. Built-ins are preferred; these show each way out to Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..plans.registry import load, query

_LEN = "SELECT p_partkey, length(p_name)::BIGINT AS n FROM part"


@query(_LEN)
def udf_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.udf(lambda s: None if s is None else len(s), "bigint")
    return load(spark, sf_dir, "part").select("p_partkey", f("p_name").alias("n"))


@query(_LEN)
def udf_arrow_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.udf(lambda s: None if s is None else len(s), "bigint", useArrow=True)
    return load(spark, sf_dir, "part").select("p_partkey", f("p_name").alias("n"))


@query(_LEN)
def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("bigint")
    def f(s: pd.Series) -> pd.Series:
        return s.str.len()

    return load(spark, sf_dir, "part").select("p_partkey", f("p_name").alias("n"))


@query("SELECT event_type, ROUND(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def udaf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(spread("value"), 6).alias("spread"))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS n FROM events")
def grouped_map_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def number(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        return pd.DataFrame({"user_id": g["user_id"], "event_id": g["event_id"], "n": range(1, len(g) + 1)})

    return load(spark, sf_dir, "events").select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(number, "user_id bigint, event_id bigint, n bigint")


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id")
def grouped_map_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(t: pa.Table) -> pa.Table:
        return pa.table({"user_id": t.column("user_id").slice(0, 1), "n": [t.num_rows]})

    return load(spark, sf_dir, "events").select("user_id", "event_id").groupBy("user_id").applyInArrow(count, "user_id bigint, n bigint")


@query("SELECT coalesce(c, s) AS k, coalesce(nc, 0)::BIGINT AS nc, coalesce(ns, 0)::BIGINT AS ns FROM (SELECT c_nationkey AS c, count(*) AS nc FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS s, count(*) AS ns FROM supplier GROUP BY 1) ON c = s")
def cogrouped_map_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "nc": [len(a)], "ns": [len(b)]})

    a = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey").groupBy("k")
    b = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey").groupBy("k")
    return a.cogroup(b).applyInPandas(both, "k int, nc bigint, ns bigint")


@query("SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier WHERE s_acctbal > 0")
def partition_map_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p[p["s_acctbal"] > 0]
            yield pd.DataFrame({"s_suppkey": p["s_suppkey"], "twice": p["s_acctbal"] * 2})

    return load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").mapInPandas(run, "s_suppkey bigint, twice double")


@query("SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier WHERE s_acctbal > 0")
def partition_map_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            p = p.filter(pc.greater(p.column("s_acctbal"), 0))
            yield pa.RecordBatch.from_arrays([p.column("s_suppkey"), pc.multiply(p.column("s_acctbal"), 2.0)], names=["s_suppkey", "twice"])

    return load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").mapInArrow(run, "s_suppkey bigint, twice double")


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def udtf_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, s: str):
            for w in s.split(" "):
                yield (w,)

    spark.udtf.register("words_of_name", Words)
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, word FROM nation, LATERAL words_of_name(n_name)")


class Runs:
    """A table function over the rows of a partition in their order: one row for each run of equal values in its last column.

    analyze() takes the names and types of the columns from the table it is given: the first is the partition's key.
    """

    def __init__(self):
        self.row, self.n = None, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the argument must be a table")
        fields = rows.dataType.fields
        kept = [T.StructField(f.name, f.dataType) for f in (fields[0], fields[-1])]
        return AnalyzeResult(T.StructType([*kept, T.StructField("run_start", fields[1].dataType), T.StructField("n", T.LongType())]))

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.row is not None and row[-1] != self.row[-1]:
            yield self.row[0], self.row[-1], self.row[1], self.n
            self.row, self.n = None, 0
        self.row = self.row or row
        self.n += 1

    def terminate(self) -> Iterator[tuple]:
        if self.row is not None:
            yield self.row[0], self.row[-1], self.row[1], self.n


@query(
    """SELECT user_id, event_type, min(ts) AS run_start, count(*)::BIGINT AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id, event_type, g"""
)
def udtf_table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types of a user, by a table argument with PARTITION BY and ORDER BY; a task holds one row of a run."""
    spark.udtf.register("runs_of", F.udtf(Runs))
    load(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql("SELECT * FROM runs_of(TABLE(SELECT user_id, ts, event_id, event_type FROM events) PARTITION BY user_id ORDER BY (ts, event_id))")


@query("SELECT c_custkey, c_acctbal * 1.1 AS v FROM customer")
def udf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tenth_more(x DOUBLE) RETURNS DOUBLE RETURN x * 1.1")
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, tenth_more(c_acctbal) AS v FROM customer")
