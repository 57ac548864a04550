"""Sources and sinks: each format written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..ship import ship
from ..plans.registry import load, query, scratch

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_SCHEMA = "n_nationkey INT, n_name STRING, n_regionkey INT"


def _again(spark: SparkSession, sf_dir: str, kind: str, write: dict | None = None, read: dict | None = None) -> DataFrame:
    path = scratch(spark)
    load(spark, sf_dir, "nation").write.format(kind).options(**(write or {})).save(path)
    return spark.read.format(kind).schema(_SCHEMA).options(**(read or write or {})).load(path)


@query(_NATION)
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, "parquet")


@query(_NATION)
def orc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, "orc")


@query(_NATION)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, "json")


@query(_NATION)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, "csv", {"header": "true"})


@query(_NATION)
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, "xml", {"rowTag": "nation"})


_HARD = """SELECT doc_id AS k, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'a "quoted" word, and ''a'' comma' || chr(10) || text || chr(9) || 'ünï' WHEN 2 THEN NULL ELSE text || ' {} slash ' END AS s, CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id * 0.25 - 1 AS DOUBLE) END AS d FROM documents"""


def _hard_again(spark: SparkSession, sf_dir: str, kind: str, options: dict) -> DataFrame:
    """Whole texts with nulls, quotes, separators, line breaks and letters beyond ASCII, written and read back."""
    path = scratch(spark)
    load(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    spark.sql(_HARD.format("\\\\")).write.format(kind).options(**options).save(path)
    return spark.read.format(kind).schema("k BIGINT, s STRING, d DOUBLE").options(**options).load(path)


@query(_HARD.format("\\"))
def csv_hard_values_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hard_again(spark, sf_dir, "csv", {"multiLine": "true", "escape": '"', "header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})


@query(_HARD.format("\\"))
def json_hard_values_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hard_again(spark, sf_dir, "json", {})


@query("SELECT n_name AS value FROM nation")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    load(spark, sf_dir, "nation").select("n_name").write.text(path)
    return spark.read.text(path)


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def partitioned_write_pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are dealt by the partition column and a salt before writing, so that each folder gets few files but is the work of several tasks; the read prunes folders."""
    path = scratch(spark)
    salt = F.pmod(F.xxhash64("o_orderkey"), F.lit(8))
    load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").repartition("o_orderstatus", salt).write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'P'")


class Squares(DataSource):
    """A batch source in Python: squares of the numbers below `n`, in `parts` partitions."""

    @classmethod
    def name(cls) -> str:
        return "squares"

    def schema(self) -> str:
        return "id BIGINT, square BIGINT"

    def reader(self, schema) -> "SquaresReader":
        return SquaresReader(int(self.options.get("n", "10")), int(self.options.get("parts", "2")))


class SquaresReader(DataSourceReader):
    def __init__(self, n: int, parts: int):
        self.n, self.parts = n, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int]]:
        for i in range(partition.value, self.n, self.parts):
            yield i, i * i


@query("SELECT event_id AS id, event_id * event_id AS square, event_type FROM events")
def custom_batch_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source makes a row for each event's id, in parts of some 100,000, which is joined to the events."""
    ship(spark)
    spark.dataSource.register(Squares)
    events = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    most = events.agg(F.max("id")).first()[0]
    n = 0 if most is None else most + 1
    made = spark.read.format("squares").option("n", str(n)).option("parts", str(max(2, n // 100_000))).load()
    return made.join(events, "id")


@query("SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY n_regionkey")
def stream_file_source_memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.queries import run_to_end

    path = scratch(spark)
    load(spark, sf_dir, "nation").write.parquet(path)
    stream = spark.readStream.schema(_SCHEMA).parquet(path)
    return run_to_end(stream.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), "complete")
