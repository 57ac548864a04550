"""Hard negatives by blocked dense matrix products.

Vectors are made whole numbers (floor(scale * x)) and packed into blocks: one row holds the ids, labels and the matrix
of up to BLOCK vectors of one length. Every anchor block meets every candidate block once a pass, and one product in
float64 gives all their scores; sums of whole numbers are exact there below 2^53, which is checked from the blocks'
largest components. (Beyond, the product is taken in 64-bit integers, exact as long as scores fit a long; scores beyond
that are cut to the range of a long.)

Pass one keeps, for each anchor, the first few candidates of its own label. What a task keeps is mergeable: the first k
of a union are among the first k of its parts, so tasks emit their own and Spark ranks these. Pass two knows each
anchor's positives, hence the window of scores that a negative must be in, and keeps the first k of each window likewise.

The anchor blocks are broadcast while their measured size is at most BROADCAST_BYTES. Beyond, both sides are dealt over
a grid: anchor groups of that size by groups of candidate blocks, joined by their cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Most vectors, and most bytes of them, in a block.
BLOCK, BLOCK_BYTES = 2048, 4_000_000
#: Most bytes of anchors that are broadcast, and of one group of anchors beyond.
BROADCAST_BYTES = 32_000_000
#: Candidate blocks in a group of the grid.
GRID_BLOCKS = 16
#: Bytes of kept candidates after which a task hands them on.
KEPT_BYTES = 64_000_000

_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max
_BLOCKS = "dims int, n int, ids binary, labels binary, matrix binary, wanted binary"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and label of the rows that take part; of rows with one vec_id, the least."""
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    held = F.struct(e.cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    one = rows.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("held")).groupBy("vec_id").agg(F.min("held").alias("held"))
    return one.select("vec_id", "held.embedding", "held.label")


def _packer(scale: float):
    """Rows of vec_id, embedding, label and wanted (up to so many numbers) as blocks; ids ascend within a block."""

    def block(dims: int, parts: list) -> pa.RecordBatch:
        ids, labels, matrix, wanted = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ids, kind="stable")
        values = [ids[order], labels[order], np.ascontiguousarray(matrix[order]), np.ascontiguousarray(wanted[order])]
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["dims", "n", "ids", "labels", "matrix", "wanted"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        for b in batches:
            sizes = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == dims))
                matrix = own.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(own), dims)
                matrix = np.clip(np.floor(np.clip(matrix, -1e150, 1e150) * scale), -1e150, 1e150)
                ids, labels = (own.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                wanted = own.column("wanted").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dims, 1))))
                held = open_.setdefault(dims, [])
                at = 0
                while at < len(own):
                    take = min(len(own) - at, most - sum(len(x[0]) for x in held))
                    held.append((ids[at : at + take], labels[at : at + take], matrix[at : at + take], wanted[at : at + take]))
                    at += take
                    if sum(len(x[0]) for x in held) >= most:
                        yield block(dims, held)
                        held.clear()
        for dims, held in open_.items():
            if held:
                yield block(dims, held)

    return pack


def _blocks(rows: DataFrame, scale: float) -> DataFrame:
    """The packed rows, written once, with a number for each block."""
    rows = rows if "wanted" in rows.columns else rows.withColumn("wanted", F.array().cast("array<bigint>"))
    packed = saved(rows.select("vec_id", "embedding", "label", "wanted").mapInArrow(_packer(scale), _BLOCKS))
    return packed.withColumn("block", F.monotonically_increasing_id())


class Best:
    """For each of some rows the first k columns seen so far: larger scores first, then smaller ids."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), _NONE), np.full((rows, k), _LAST)

    def add(self, scores: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """scores: rows x columns; ids ascend; only where fit."""
        n, k = self.score.shape
        worst, worst_id = self.score[:, -1:], self.id[:, -1:]
        keep = fit & ((scores > worst) | ((scores == worst) & (ids[None, :] < worst_id)))
        if keep.sum(axis=1).max(initial=0) > k:  # cut at the k-th largest; of its equals the first k are enough, since ids ascend
            held = np.where(keep, scores, _NONE)
            cut = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k, None]
            level = keep & (held == cut)
            keep &= (held > cut) | (level & (np.cumsum(level, axis=1) <= k))
        row, col = np.nonzero(keep)
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, k), row])
        all_scores = np.concatenate([self.score[touched].ravel(), scores[row, col]])
        all_ids = np.concatenate([self.id[touched].ravel(), ids[col]])
        order = np.lexsort((all_ids, ~all_scores, rows))  # ~x falls as x rises, without overflow
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        at = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        take = at < k
        self.score[rows[take], at[take]] = all_scores[order][take]
        self.id[rows[take], at[take]] = all_ids[order][take]


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as longs."""
    bound = np.abs(a).max(initial=0.0) * np.abs(c).max(initial=0.0) * max(a.shape[1], 1)
    if bound < 2**53:
        return (a @ c.T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ c.astype(np.int64).T
    return np.clip(np.nan_to_num(a @ c.T), -(2.0**62), 2.0**62).astype(np.int64)


def _searcher(windows: int, k: int, low: int, high: int):
    """windows 0: the first k of an anchor's own label. Else: for each of its positives, the first k of other labels in the window."""

    def bounds(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.ones((len(wanted), windows), np.int64), np.zeros((len(wanted), windows), np.int64)
        for i, row in enumerate(wanted.reshape(len(wanted), windows, 2).tolist()):
            for j, (score, _) in enumerate(row):
                if score != _NONE:
                    lo[i, j], hi[i, j] = -(-low * score // 100), high * score // 100
        return lo, hi

    def emit(kept: dict) -> Iterator[pa.RecordBatch]:
        for ids, _, wanted, best in kept.values():
            for j, b in enumerate(best):
                row, col = np.nonzero(b.id != _LAST)
                aim = wanted.reshape(len(ids), windows, 2)[row, j] if windows else np.zeros((len(row), 2), np.int64)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], aim[:, 1], aim[:, 0], b.id[row, col], b.score[row, col])], names=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        size = 0
        for b in batches:
            for r in range(len(b)):
                get = lambda c, kind, r=r, b=b: np.frombuffer(b.column(c)[r].as_buffer(), kind)
                block, dims = b.column("a_block")[r].as_py(), b.column("dims")[r].as_py()
                a_ids, c_ids, a_labels, c_labels = get("a_ids", np.int64), get("ids", np.int64), get("a_labels", np.int64), get("labels", np.int64)
                if block not in kept:
                    wanted = get("a_wanted", np.int64).reshape(len(a_ids), -1)
                    best = [Best(len(a_ids), k) for _ in range(max(1, windows))]
                    kept[block] = (a_ids.copy(), bounds(wanted) if windows else None, wanted.copy(), best)
                    size += sum(x.id.nbytes + x.score.nbytes for x in best) + wanted.nbytes
                _, limits, _, best = kept[block]
                scores = products(get("a_matrix", np.float64).reshape(len(a_ids), dims), get("matrix", np.float64).reshape(len(c_ids), dims))
                same = a_labels[:, None] == c_labels[None, :]
                if windows:
                    for j, x in enumerate(best):
                        x.add(scores, c_ids, ~same & (scores >= limits[0][:, j, None]) & (scores <= limits[1][:, j, None]))
                else:
                    best[0].add(scores, c_ids, same & (a_ids[:, None] != c_ids[None, :]))
                if size > KEPT_BYTES:
                    yield from emit(kept)
                    kept, size = {}, 0
        yield from emit(kept)

    return search


def _met(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each candidate block beside each anchor block of vectors of the same length."""
    right = anchors.select("dims", F.col("block").alias("a_block"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "matrix", "wanted")])
    size = anchors.agg(F.sum(F.length("matrix") + F.length("wanted"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return blocks.join(F.broadcast(right), "dims").drop("block")
    columns = -(-size // BROADCAST_BYTES)
    rows = -(-blocks.count() // GRID_BLOCKS)
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    left = blocks.withColumn("row", cell("block", rows)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).drop("block")
    right = right.withColumn("col", cell("a_block", columns)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return left.withColumn("col", F.col("col").cast("long")).join(right.withColumn("row", F.col("row").cast("long")), ["dims", "row", "col"])


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256) -> DataFrame:
    """rows: vec_id, embedding, label. anchors: which rows are anchors, by vec_id. One row for each anchor, positive and negative.

    Positives are an anchor's first other rows of its label; negatives, for each positive, the first rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score. First means larger scores, then smaller ids.
    Null ids, labels or vectors and null or non-finite components take no part. Rows that share a vec_id count once, as
    the least by vector and label. Only vectors of one length are compared; empty ones score 0 with each other. An
    anchor without positives, or a positive without negatives, has no rows. Empty table: no rows.
    """
    small_batches(rows.sparkSession)
    found = "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"
    few = max(1, -(-rows.count() // BLOCK))  # no more tasks than full blocks: each task hands on its own first k of each anchor
    rows = usable(rows)
    blocks = _blocks(rows.coalesce(few), scale)
    asked = saved(rows.where(anchors))
    few = max(1, -(-asked.count() // BLOCK))
    first = _met(blocks, _blocks(asked.repartition(few, "vec_id"), scale)).mapInArrow(_searcher(0, positives, low, high), found)
    at = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    best = first.withColumn("at", at).where(F.col("at") <= positives)
    none = F.array(F.lit(_NONE), F.lit(_LAST))
    aims = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("at", F.array("score", "vec_id").alias("aim")))).alias("aims"))
    wanted = F.flatten(F.concat(F.transform("aims", lambda x: x["aim"]), F.array_repeat(none, F.lit(positives) - F.size("aims"))))
    aimed = asked.join(aims.select(F.col("anchor_id").alias("vec_id"), wanted.alias("wanted")), "vec_id")
    second = _met(blocks, _blocks(aimed.repartition(few, "vec_id"), scale)).mapInArrow(_searcher(positives, negatives, low, high), found)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    ranked = second.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
