"""Mixing sources to target weights, with built-in functions only.

A source's target comes from its weight by water filling: all sources share the budget by weight, none takes
more than `most` times its size, and what that leaves over is shared again by weight. A round is two sums over the
table of sources, which tell the share of those that still take more; rounds end when none is filled any more. The
rank that gives a source its weight is counted by ranges of the source, so no task holds all of them.
A document is emitted floor(rate) times, and once more if its hash, seeded, falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Most bytes of targets that are broadcast, and over how many tasks a source is dealt beyond that.
BROADCAST = 16 << 20
SALTS = 32


def word_count(text) -> F.Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weighted(sizes: DataFrame, weights) -> DataFrame:
    """source, source_size, weight: one row a source; weights go round the sources in order."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranges = saved(by.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a partition
    at = F.row_number().over(Window.partitionBy("range").orderBy(order)) + F.col("before") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int"))
    return saved(ranges.join(F.broadcast(before), "range").select("source", "source_size", weight.alias("weight")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, size. Returns source, source_size, target, rate: one row a source.

    Weights go round the sources by code point, null last. A source of size 0 has target 0 and rate 0.
    """
    by = _weighted(sizes, weights).withColumn("cap", F.col("source_size") * most)
    total, open_weight = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget = left = float(total) * share
    is_open = lambda: F.col("cap") * F.lit(open_weight) > F.lit(left) * F.col("weight")
    while True:
        filled, still = by.agg(F.coalesce(F.sum(F.when(~is_open(), F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(is_open(), F.col("weight"))), F.lit(0))).first()
        if still in (0, open_weight):  # all are filled, or none more than before
            break
        left, open_weight = budget - filled, still
    target = F.when(is_open(), F.lit(left) * F.col("weight") / F.lit(open_weight)).otherwise(F.col("cap").cast("double"))
    return by.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(doc_id, rate, seed: str = SEED) -> F.Column:
    """floor(rate), plus one with the probability of the fraction: the first 32 bits of a seeded digest decide."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_target(rows: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """Rows joined with the target of their source (columns _source and what else targets has), which null has too.

    The targets are broadcast if they are measured to be at most BROADCAST bytes, so that no text is shuffled. More of
    them are joined by source and a salt, as one source may hold much of all rows.
    """
    n, size = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_source")), F.lit(0))).first()
    if size + 64 * n <= BROADCAST:
        return rows.join(F.broadcast(targets), F.col(source).eqNullSafe(F.col("_source")))
    salted = rows.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
    many = targets.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_to"))).drop("_salt", "_to")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, n_copies for each row of docs (doc_id, source, text).

    Sizes are counted once and kept, so the texts are read once. Rows with the same doc_id get the same number
    of copies; a null text has size 0; a null source is a source of its own, the last. Empty table: no rows.
    """
    sizes = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    both = _with_target(sizes, "source", targets)
    return both.select("doc_id", "source", "size", "source_size", "target", copies(F.col("doc_id"), F.col("rate"), seed).alias("n_copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as its source's rate says, all columns kept, plus copy (from 0).

    A column of docs named copy is replaced. A null text has size 0 and goes with its source's rate like any other, and
    so does an empty one; a null source is a source of its own; rows alike get the same number of copies. Empty table:
    no rows. Texts are read twice, for sizes and for the mix, and are not shuffled where targets can be broadcast.
    """
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sizes, weights, share, most).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    rows = docs.drop("copy")
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    many = _with_target(packed, "row.source", targets).withColumn("n", copies(F.col("row.doc_id"), F.col("_rate"), seed)).where("n > 0")
    many = many.select("row", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy"))
    return many.select("row.*", "copy")
