"""A corpus pipeline: toxicity, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, ngram_join, secrets, toxicity
from tessera.llm.common import removed, table, written

#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go; the model learns from labels of the documents at hand.

    Null, empty and wordless texts have the score of a text without toxic words and stay. Rows alike score alike, so they
    stay or go together. Without usable labels, or on an empty table, nothing goes. All columns stay as they are.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.reject(docs, model, TOXIC)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near-duplicate links, the document with the smallest id stays.

    Null, empty and wordless texts link with nothing and stay. Rows that share an id but not the text are documents of
    their own (ties: the smaller hash of the text). Of rows alike in id and text one stays, the one with the smallest
    hash of its other columns, whatever the order of rows. Null ids come first. Empty table: no rows.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))  # tells rows apart that share an id
    found = ngram_join.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    kept = found.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("key")).distinct()
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(key.alias("key"), F.xxhash64(F.to_json(F.struct(*others)) if others else F.lit(0)).alias("other"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = F.row_number().over(Window.partitionBy("key").orderBy("other"))
    return rows.join(kept, "key", "left_semi").withColumn("at", at).where("at = 1").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go.

    Null and empty texts hold no window and stay; rows alike stay or go together; an empty benchmark, or an empty table,
    leaves all rows. All columns stay as they are.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans of secrets are replaced by a mark, and n_chars follows.

    Spans that overlap get one mark. A null text stays null and an empty one empty, with n_chars as it was; so does any
    text without secrets. Repeated rows are redacted each. Empty table: no rows.
    """
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = secrets.find_secrets(rows)
    found = found.withColumn("text", F.when(F.size("spans") > 0, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says, with its copy's number (column copy, from 0).

    Null and empty texts have size 0 and go with their source's rate; a null source is a source of its own, the last;
    rows of one id get the same number of copies. Empty table: no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
]

#: The first stage's model can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet to the shared folder and read again.

    A stage's files go once the next one's are written; only those that the result reads stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
