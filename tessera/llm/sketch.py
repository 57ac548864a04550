"""A count-min sketch of 64-bit keys that is built in parts, merged by slices, and kept as bits.

Each of the sketch's two rows has 2**bits cells. A task hashes its keys to cells, sorts them, and emits its
partial sketch sparsely: per slice of 2**20 cells the sorted cells as deltas, in levels (cells that it counted
once at least, twice, four times, ...). Slices are merged where Spark shuffles them to, by adding these
rounded-down counts. A merged count overestimates the keys of a cell up to that rounding, never below 2 where
two keys met, so "both cells have 2 or more" holds for every key that occurs twice.

What goes to the driver and is broadcast is one bit a cell (2 or more), at most 2**MOST_BITS cells a row: 64 MB
for both rows, whatever the input; where hot cells are asked for, a second bit a cell, 128 MB in all. Beyond that size the sketch fills and excludes fewer keys; results stay whole.

repeated_finely() counts in one row of 2**FINER times as many cells, which are nowhere held at once, and keeps a bit for
each 2**FINER of them (at most 128 MB, and 8 MB for hot ones). Such a sketch fills with keys that do repeat, not with all keys.
Where few do, it is folded: bits side by side become one, as long as at most one in SPARSE is set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, saved

SLICE = 20
ROWS = 2
MOST_BITS = 28
LEAST_BITS = 20
_SEEDS = (11, 23)
#: Powers of two: fine cells a bit, bits a hot bit, and the fewest slices.
FINER, HOTTER, LEAST_SLICES = 6, 4, 5
#: Keys that a slice of fine cells meets, about; they are sorted in one task, and counted so many at once.
SLICE_KEYS, COUNTED = 2_000_000, 1 << 17
#: A sketch of fine cells is folded while at most one bit in so many is set.
SPARSE = 16
#: Keys are cut to partial sketches at so many, which bounds a task's memory.
FLUSH = 3_000_000


def bits_for(keys: float) -> int:
    """About two cells a key in each row."""
    return min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(1.0, 2 * keys)))))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(keys, _SEEDS[row]) >> np.uint64(64 - bits)


def encode(deltas: np.ndarray) -> bytes:
    """Non-negative numbers in one byte each or, where they are larger, two (the largest value means go on), or else in four."""
    mean = deltas.mean() if len(deltas) else 0
    if mean > 65535:
        return b"\1" + deltas.astype("<u4").tobytes()
    kind, top = ("<u2", 65535) if mean > 255 else ("u1", 255)
    more = deltas // top
    out = np.full(len(deltas) + int(more.sum()), top, kind)
    out[np.cumsum(more + 1) - 1] = deltas % top
    return (b"\2" if mean > 255 else b"\0") + out.tobytes()


def decode(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\1":
        return np.frombuffer(raw, "<u4", offset=1).astype(np.int64)
    values = np.frombuffer(raw, "<u2" if raw[:1] == b"\2" else "u1", offset=1)
    total = np.cumsum(values, dtype=np.int64)
    return np.diff(total[values != np.iinfo(values.dtype).max], prepend=np.int64(0))


def _partial(at: np.ndarray, row: int, bits: int, width: int = SLICE) -> Iterator[pa.RecordBatch]:
    """at: the cells of one row; sorted in place."""
    at.sort()
    slices, levels, packed = [], [], []
    # slice by slice, so that what is made beside the cells is as long as a slice
    cuts = np.searchsorted(at, np.arange(1, 1 << (bits - width), dtype=at.dtype) << at.dtype.type(width))
    for i, (start, end) in enumerate(zip(np.append(0, cuts), np.append(cuts, len(at)))):
        own = at[start:end]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        counts, own = np.diff(first, append=len(own)), own[first]
        level = 0
        while len(own):
            slices.append((row << (bits - width)) | i)
            levels.append(level)
            packed.append(encode(np.diff((own & own.dtype.type((1 << width) - 1)).astype(np.int64), prepend=-1) - 1))
            level += 1
            keep = counts >= (1 << level)
            own, counts = own[keep], counts[keep]
    yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(levels, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "level", "cells"])


def partials(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, rows: int = ROWS, width: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Partial sketches of at most FLUSH keys each; only their cells are held, in four bytes each (eight beyond 2**32 cells)."""
    kind = np.uint32 if bits <= 32 else np.uint64
    held, n = [np.empty(0, kind) for _ in range(rows)], 0
    for batch in batches:
        for keys in keys_of(batch):
            if n and n + len(keys) > FLUSH:
                for row in range(rows):
                    yield from _partial(held[row][:n], row, bits, width)
                n = 0
            if n + len(keys) > len(held[0]):
                held = [np.concatenate((h[:n], np.empty(max(len(keys), min(n, FLUSH - n)), kind))) for h in held]
            for row in range(rows):
                held[row][n : n + len(keys)] = cells(keys, row, bits)
            n += len(keys)
    if n:
        for row in range(rows):
            yield from _partial(held[row][:n], row, bits, width)


def _merge(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # level 0 adds one to each of its cells; level k raises a count of 2**(k-1) to 2**k
        counts = np.zeros(1 << SLICE, np.int64 if hot else np.uint16)
        at_slice = None
        for batch in batches:
            at_slice = batch.column("slice")[0].as_py()
            for level, raw in zip(batch.column("level").to_pylist(), batch.column("cells")):
                at = np.cumsum(decode(raw.as_py()) + 1) - 1
                add = 1 if level == 0 else 1 << (level - 1)
                if hot:
                    counts[at] += add
                else:
                    counts[at] = np.minimum(counts[at] + np.uint16(min(add, 2)), 2)
        hots = np.packbits(counts >= hot).tobytes() if hot else b""
        yield pa.RecordBatch.from_arrays([pa.array([at_slice], pa.int32()), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary()), pa.array([hots], pa.binary())], names=["slice", "bits", "hots"])

    return run


class Repeated:
    """The merged sketch as tasks hold it: which cells have 2 or more, and (if asked for) which are hot."""

    def __init__(self, bits: int, raw: bytearray, hots: bytearray, rows: int = ROWS, hotter: int = 0):
        self.bits, self.raw, self.hots, self.rows, self.hotter = bits, raw, hots, rows, hotter

    def _all(self, cell_bits: bytearray, keys: np.ndarray, bits: int) -> np.ndarray:
        """Whether a key's cell has its bit in all rows."""
        flat, out = np.frombuffer(cell_bits, np.uint8), None
        for row in range(self.rows):
            at = cells(keys, row, bits).astype(np.int64)
            bit = (flat[(row << (bits - 3)) + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1
            out = bit.astype(bool) if out is None else out & bit.astype(bool)
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Whether the sketch's estimate for a key is 2 or more."""
        return self._all(self.raw, keys, self.bits)

    def hot(self, keys: np.ndarray) -> np.ndarray:
        """Whether the estimate reaches the hot count."""
        return self._all(self.hots, keys, self.bits - self.hotter) if len(self.hots) else np.zeros(len(keys), bool)


def repeated(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, hot: int = 0) -> Repeated:
    """The merged sketch of all keys of docs; hot: the estimate from which a key counts as very frequent (0: none)."""
    parts = docs.mapInArrow(lambda batches: partials(batches, keys_of, bits), "slice int, level int, cells binary")
    merged = parts.groupBy("slice").applyInArrow(_merge(hot), "slice int, bits binary, hots binary")
    width = 1 << (SLICE - 3)
    raw = bytearray(width * (ROWS << (bits - SLICE)))
    hots = bytearray(len(raw) if hot else 0)
    # one or two bits a cell, bounded by MOST_BITS, and partition by partition: never twice in the driver
    for r in saved(merged).toLocalIterator():
        at = slice(r["slice"] * width, (r["slice"] + 1) * width)
        raw[at] = r["bits"]
        if hot:
            hots[at] = r["hots"]
    return Repeated(bits, raw, hots)


def _merge_fine(width: int, hot: int):
    """width: a slice has 2**width fine cells."""

    def mark(to: np.ndarray, at: np.ndarray) -> None:
        """Sets the bits numbered `at`, which come in order."""
        if len(at):
            byte = at >> 3
            first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
            to[byte[first]] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at_slice = [], None
        for batch in batches:
            at_slice = batch.column("slice")[0].as_py()
            for level, raw in zip(batch.column("level").to_pylist(), batch.column("cells")):
                held.append((np.cumsum(decode(raw.as_py()) + 1) - 1) << 6 | level)
        every = np.concatenate(held)
        held.clear()
        every.sort()
        bits, hots = (np.zeros(1 << (width - x - 3), np.uint8) for x in (FINER, FINER + HOTTER))
        i = 0
        while i < len(every):
            j = int(np.searchsorted(every, ((every[min(i + COUNTED, len(every)) - 1] >> 6) + 1) << 6))  # whole cells
            level, cell = every[i:j] & 63, every[i:j] >> 6
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            counts, cell = np.add.reduceat(1 << np.maximum(level - 1, 0), first), cell[first]
            mark(bits, cell[counts >= 2] >> FINER)
            mark(hots, cell[counts >= hot] >> (FINER + HOTTER))
            i = j
        yield pa.RecordBatch.from_arrays(
            [pa.array([at_slice], pa.int32()), pa.array([int(np.bitwise_count(bits).sum(dtype=np.int64))], pa.int64()), pa.array([bits.tobytes()], pa.binary()), pa.array([hots.tobytes()], pa.binary())],
            names=["slice", "n", "bits", "hots"],
        )

    return run


#: Of a byte, four bits that are set where either of two bits side by side is.
_PAIRS = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 4, 2).any(2), axis=1)[:, 0] >> 4


def folded(bits: bytes, times: int) -> bytes:
    """Half as many bits each time, of which one is set where either of two side by side was."""
    flat = np.frombuffer(bits, np.uint8)
    for _ in range(times):
        flat = _PAIRS[flat[::2]] << 4 | _PAIRS[flat[1::2]]
    return flat.tobytes()


def repeated_finely(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], keys: float, hot: int) -> Repeated:
    """As repeated(), for about so many keys, by one row of fine cells of which 2**FINER share a bit.

    A key counts as repeated if any cell beside its own met two keys. Each slice has about SLICE_KEYS keys, which its task sorts.
    Folding lets more cells stand beside a key's own, but never hides a repeated key.
    """
    bits = bits_for(keys) + 2
    parts = max(LEAST_SLICES, math.ceil(math.log2(max(1.0, keys / SLICE_KEYS))))
    width = bits + FINER - parts
    made = docs.mapInArrow(lambda batches: partials(batches, keys_of, bits + FINER, 1, width), "slice int, level int, cells binary")
    merged = saved(made.groupBy("slice").applyInArrow(_merge_fine(width, hot), "slice int, n bigint, bits binary, hots binary"))
    n = merged.agg(F.sum("n")).first()[0] or 0
    # a slice keeps a byte at least, and there are no fewer bits than hot ones
    fold = max(0, min(HOTTER, bits - parts - 3, bits - math.ceil(math.log2(max(1, SPARSE * n)))))
    bits, hotter = bits - fold, HOTTER - fold
    raw, hots = bytearray(1 << (bits - 3)), bytearray(1 << (bits - hotter - 3))
    for r in merged.toLocalIterator():
        for to, of in ((raw, folded(r["bits"], fold)), (hots, r["hots"])):
            to[r["slice"] * len(of) : (r["slice"] + 1) * len(of)] = of
    return Repeated(bits, raw, hots, 1, hotter)


def text_bytes(docs: DataFrame) -> int:
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
