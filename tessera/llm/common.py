"""What the operators of this subpackage share: tables, the shared folder, vectorised words and hashes.

Text work that needs Python runs on whole Arrow batches with numpy: words are found and hashed for all
texts of a batch at once, so that the cost is a few nanoseconds a byte and no Python object is made a word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Words of the contract: runs of bytes other than space and \t \n \v \f \r (which is what bytes.split() splits on).
WORD = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15
_OTHER_BASE = 0xE7037ED1A0B428DB
_STEP = 0xD6E8FEB86659FD93
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_shared(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says. A local session may have a folder of our own; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there: lineage ends, and lost executors lose nothing."""
    ensure_shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as Parquet in a new folder of the shared one, read from there, and the folder's path.

    Unlike a checkpoint it keeps columns apart, so later reads take only those they need.
    """
    spark = df.sparkSession
    ensure_shared(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written() made, once no frame reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of texts hold at most so many rows, so that a Python worker's memory is bounded.

    Their bytes are bounded by Spark's own default of 64 MB (spark.sql.execution.arrow.maxBytesPerBatch). The setting is
    the session's, and plans read it when they run, so it stays; a lower one of the caller is kept.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def prefix_sums(lengths, part: int = 512) -> Column:
    """For an array of whole numbers, that of the sums of the elements before each.

    aggregate() copies what it has appended so far at each step, so sums are taken over parts, and over the parts' totals.
    """
    none = F.array().cast("array<bigint>")

    def running(xs, start):
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(xs, F.struct(start.cast("bigint").alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(part)), lambda i: F.slice(lengths, i, part))
    totals = F.transform(parts, lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return F.flatten(F.zip_with(parts, running(totals, F.lit(0)), running))


def in_train(doc_id) -> Column:
    """Rows from which labels may be learned: crc32 of the id as text, modulo 3, is not 1 (null id: taken as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


# -- vectorised words ---------------------------------------------------------------------------------------

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CODE, _OTHER_CODE = np.random.default_rng(20240607).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit finaliser of a well-known hash: all bits of the result depend on all bits of x."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[base] = (made[0], made[1])
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and n + 1 offsets into them; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def blocks(offs: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes (a longer text is a range of its own)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of texts that lie one after the other."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


#: Bytes that are hashed at once, and words of which runs are: tables of powers and running sums are no longer than that.
PIECE = 1 << 17


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, code: np.ndarray) -> np.ndarray:
    """Of each word, the sum of its bytes' codes times powers of the base."""
    up, down = powers(base, len(data) + 1)
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum(code[data] * up[: len(data)], out=run[1:])
    return (run[ends] - run[starts]) * down[starts]


def _long_sum(data: np.ndarray, base: int, code: np.ndarray) -> np.ndarray:
    """The same for one word that is longer than a piece: the sums of its pieces, each raised to where it lies."""
    cuts = range(0, len(data), PIECE)
    ends = [np.array([min(PIECE, len(data) - at)]) for at in cuts]
    return np.sum([_sums(data[at : at + PIECE], np.zeros(1, np.int64), end, base, code) * np.uint64(pow(base, at, 2**64)) for at, end in zip(cuts, ends)], axis=0, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes by differences of a running sum. other: a second, independent one.

    Words come in order. They are hashed in pieces of the data, so memory doesn't grow with the longest text or word.
    """
    base, code = (_OTHER_BASE, _OTHER_CODE) if other else (_BASE, _CODE)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + PIECE, "right")))
        part = data[at : ends[j - 1]]
        out[i:j] = _sums(part, starts[i:j] - at, ends[i:j] - at, base, code) if len(part) <= PIECE else _long_sum(part, base, code)
        i = j
    return mix(out)


def rolling(hashes: np.ndarray, rows: np.ndarray, k: int, base: int = _STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each run of k words within one row."""
    n = max(0, len(hashes) - k + 1)
    first = np.flatnonzero(rows[k - 1 :] == rows[:n]) if n else np.zeros(0, np.int64)
    out, i = np.empty(len(first), np.uint64), 0
    while i < len(first):
        at = first[i]
        j = int(np.searchsorted(first, at + PIECE, "left"))
        starts = first[i:j] - at
        part = hashes[at : first[j - 1] + k]
        up, down = powers(base, PIECE + k)
        run = np.empty(len(part) + 1, np.uint64)
        run[0] = 0
        np.cumsum(part * up[: len(part)], out=run[1:])
        out[i:j] = (run[starts + k] - run[starts]) * down[starts]
        i = j
    return first, mix(out)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]
