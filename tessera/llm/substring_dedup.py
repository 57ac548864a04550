"""Substring dedup: a count-min sketch excludes windows that occur once; the rest are grouped exactly.

A window is estimated by its anchor: of the grams of GRAM words in it, the one with the least hash. Windows with the
same words have the same anchor at the same place, so an anchor occurs at least as often as the window. First pass: the
grams that are the anchor of any window, some one in twelve, are counted, and partial sketches are merged (see
sketch.py). Second pass: windows whose anchor's estimate is 2 or more are grouped by a 96-bit key, with at most one row
a window and task. Those that then turn out to occur once are the sketch's mistakes, or share a passage shorter than a
window; their positions go back to their documents. Third pass: every other such window covers its words, and covered
words go. No repeated window is lost, since a sketch never underestimates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import blocks, mix, rolling, small_batches, utf8, word_hashes, word_spans
from .sketch import decode, encode

WINDOW = 35
#: Words of a gram: the more, the fewer grams occur twice by chance; the fewer, the fewer grams are anchors.
GRAM = 12
#: Cells of the sketch for each anchor, as long as it can grow.
ROOM = 8
_FLUSH = 500_000
_OTHER, _GRAM = 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of x[i : i + w] for each i, in as many steps as w has bits."""
    span = 1
    while span * 2 <= w:
        x, span = best(x[:-span], x[span:]), span * 2
    return best(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def _anchors(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's hash of each window of k words within a row, and the hash of each gram that is an anchor.

    Grams that tie for the least hash of a window are all taken, so windows that overlap themselves count each place.
    """
    n, q = len(words), min(GRAM, k)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    w = k - q + 1
    first, hashes = rolling(words, rows, q, _GRAM)
    grams = np.full(n - q + 1, np.iinfo(np.uint64).max, np.uint64)
    grams[first] = hashes
    least = _sliding(grams, w, np.minimum)  # one for each of the n - k + 1 windows, those across rows too
    whole = rows[k - 1 :] == rows[: n - k + 1]
    # a gram is an anchor if the greatest of the least hashes of the windows that hold it is its own
    around = np.zeros(len(grams) + w - 1, np.uint64)
    around[w - 1 : w - 1 + len(least)] = np.where(whole, least, 0)
    return least[whole], grams[first][_sliding(around, w, np.maximum)[first] == hashes]


def _windows(texts: pa.Array, k: int, check: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of rows: first row; row, position (in words), anchor and (if `check`) 96 bits of hash of each window; words of each row."""
    data, offs = utf8(texts)
    for i, j in blocks(offs):
        part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, rows = word_spans(part, at)
        words = word_hashes(part, starts, ends)
        first, hashes = rolling(words, rows, k) if check else (np.flatnonzero(rows[k - 1 :] == rows[: max(0, len(rows) - k + 1)]), None)
        more = (rolling(word_hashes(part, starts, ends, other=True), rows, k, _OTHER)[1] >> np.uint64(32)).astype(np.uint32) if check else None
        n_words = np.bincount(rows, minlength=j - i)
        begin = np.concatenate(([0], np.cumsum(n_words)))[:-1]
        row = rows[first]
        yield i, row, first - begin[row], _anchors(words, rows, k)[0], hashes, more, n_words


def _keys(k: int):
    """The anchors of a batch of texts."""

    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offs = utf8(batch.column("text"))
        for i, j in blocks(offs):
            part = data[offs[i] : offs[j]]
            starts, ends, rows = word_spans(part, offs[i : j + 1] - offs[i])
            yield _anchors(word_hashes(part, starts, ends), rows, k)[1]

    return run


def _maybe(seen: sketch.Repeated, anchors: np.ndarray) -> np.ndarray:
    """Whether each window's anchor may occur twice; windows in a row mostly share one."""
    heads = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1]))) if len(anchors) else np.zeros(0, np.int64)
    return np.repeat(seen(anchors[heads]), np.diff(heads, append=len(anchors)))


def _grouped(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and where each key begins in it."""
    order = np.argsort(h, kind="stable")
    s, t = h[order], c[order]
    same = s[1:] == s[:-1]
    if np.any(same & (t[1:] != t[:-1])):
        order = np.lexsort((c, h))
        s, t = h[order], c[order]
        same = s[1:] == s[:-1]
    return order, np.flatnonzero(np.concatenate(([True], ~(same & (t[1:] == t[:-1])))))


def _key_rows(found: list[tuple[np.ndarray, ...]], ids: list[tuple[np.ndarray, np.ndarray]], n_slices: int) -> Iterator[pa.RecordBatch]:
    """One entry a window and flush, packed by slice: keys seen once, their documents and positions; keys seen more often.

    ids: the two parts of the documents' keys; documents are numbered as they stand there.
    """
    h, c, doc, pos = (np.concatenate(x) for x in zip(*found))
    id_a, id_b = (np.concatenate(x) for x in zip(*ids))
    order, first = _grouped(h, c)
    many = np.diff(first, append=len(h)) > 1
    keep = order[first]
    h, c, doc, pos = h[keep], c[keep], doc[keep], pos[keep]
    part = (mix(h, 5) % np.uint64(n_slices)).astype(np.int64)
    order = np.lexsort((pos, doc, many, part))
    h, c, doc, pos, part, many = h[order], c[order], doc[order], pos[order], part[order], many[order]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    slices, packed = [], []
    for i, j in zip(cuts, np.append(cuts[1:], len(h))):
        m = i + int(np.searchsorted(many[i:j], True))
        begin = np.flatnonzero(np.concatenate(([True], doc[i + 1 : m] != doc[i : m - 1]))) if m > i else np.zeros(0, np.int64)
        gaps = np.diff(pos[i:m].astype(np.int64), prepend=0)
        gaps[begin] = pos[i:m][begin]
        docs, counts = doc[i:m][begin], np.diff(begin, append=m - i)
        slices.append(int(part[i]))
        packed.append(b"".join((np.array([j - i, m - i, len(docs)], "<i8").tobytes(), h[i:j].tobytes(), c[i:j].tobytes(), id_a[docs].tobytes(), id_b[docs].tobytes(), counts.astype("<u4").tobytes(), encode(gaps))))
    yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "packed"])


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    """Keys, the two parts of documents' keys, and positions; position -1: seen more often."""
    n, m, n_docs = np.frombuffer(raw, "<i8", 3).tolist()
    h, c = np.frombuffer(raw, np.uint64, n, 24), np.frombuffer(raw, np.uint32, n, 24 + 8 * n)
    at = 24 + 12 * n
    id_a, id_b = np.frombuffer(raw, "<i8", n_docs, at), np.frombuffer(raw, "<i4", n_docs, at + 8 * n_docs)
    counts = np.frombuffer(raw, "<u4", n_docs, at + 12 * n_docs).astype(np.int64)
    a, b, pos = np.zeros(n, np.int64), np.zeros(n, np.int32), np.full(n, -1, np.int64)
    if m:
        gaps = decode(raw[at + 16 * n_docs :])
        run = np.cumsum(gaps)
        begin = np.cumsum(counts) - counts
        a[:m], b[:m] = np.repeat(id_a, counts), np.repeat(id_b, counts)
        pos[:m] = run - np.repeat(run[begin] - gaps[begin], counts)
    return h, c, a, b, pos


def _candidates(seen, k: int, n_slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, n, n_docs = [], [], 0, 0
        for batch in batches:
            ids.append((batch.column("rk").to_numpy(zero_copy_only=False), batch.column("rk2").to_numpy(zero_copy_only=False)))
            for i, row, pos, anchors, hashes, more, _ in _windows(batch.column("text"), k, True):
                hit = np.flatnonzero(_maybe(seen.value, anchors))
                if len(hit):
                    found.append((hashes[hit], more[hit], n_docs + i + row[hit], pos[hit].astype(np.int32)))
                    n += len(hit)
                if n >= _FLUSH:
                    yield from _key_rows(found, ids, n_slices)
                    found, n = [], 0
            n_docs += batch.num_rows
            if not n:
                ids, n_docs = [], 0
        if n:
            yield from _key_rows(found, ids, n_slices)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a slice that occur once in all: document and position."""
    h, c, a, b, pos = (np.concatenate(x) for x in zip(*(_unpacked(raw.as_py()) for batch in batches for raw in batch.column("packed"))))
    order, first = _grouped(h, c)
    lone = order[first[np.diff(first, append=len(h)) == 1]]
    lone = lone[pos[lone] >= 0]
    lone = lone[np.lexsort((pos[lone], b[lone], a[lone]))]
    a, b, p = a[lone], b[lone], pos[lone]
    cuts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    offsets = np.append(cuts, len(a)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(a[cuts]), pa.array(b[cuts]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.astype(np.int32)))], names=["rk", "rk2", "lone"])


def _removal(seen, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            lone = batch.column("lone")
            n = batch.num_rows
            n_words, n_removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            for i, row, pos, anchors, _, _, counts in _windows(texts, k):
                n_words[i : i + len(counts)] = counts
                hit = _maybe(seen.value, anchors)
                cut = np.searchsorted(row, np.arange(len(counts) + 1))
                for r in range(len(counts)):
                    at = pos[cut[r] : cut[r + 1]][hit[cut[r] : cut[r + 1]]]
                    if len(at) and lone[i + r].is_valid:
                        at = np.setdiff1d(at, np.concatenate(lone[i + r].as_py()), assume_unique=True)
                    words = (texts[i + r].as_py() or "").encode("utf-8", "surrogatepass").split()
                    if len(at):
                        step = np.zeros(len(words) + 1, np.int32)
                        step[at] += 1
                        np.subtract.at(step, at + k, 1)
                        gone = np.cumsum(step[:-1]) > 0
                        n_removed[i + r] = gone.sum()
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    kept[i + r] = b" ".join(words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_removed), pa.array([x.decode("utf-8", "surrogatepass") for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, n_removed, kept (kept words, one space between).

    A word goes if any window that covers it has a word sequence that starts at another place too, in whatever
    document; windows are judged on the input. Null or empty text: no words, kept is ''. Texts shorter than
    the window keep all. Rows that repeat are each other's repeats. Words are `[^\\x20\\x09-\\x0D]+`.
    Rows are told apart by 96 bits of hash of id and text: two rows alike in both have no window that occurs once.
    Other columns are not read. Empty table: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"), F.hash("text", "doc_id", F.lit(7)).alias("rk2"))
    size = sketch.text_bytes(rows)
    anchors = size / 6.4 * 2 / (window - min(GRAM, window) + 2)
    seen = spark.sparkContext.broadcast(sketch.repeated(rows.select("text"), _keys(window), sketch.bits_for(anchors * ROOM / 2)))
    n_slices = max(24, size // 8_000_000)
    keys = rows.mapInArrow(_candidates(seen, window, n_slices), "slice int, packed binary")
    lone = keys.groupBy("slice").applyInArrow(_once, "rk bigint, rk2 int, lone array<int>").groupBy("rk", "rk2").agg(F.collect_list("lone").alias("lone"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = rows.join(lone, ["rk", "rk2"], "left").select("doc_id", "text", "lone")
    return both.mapInArrow(_removal(seen, window), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def with_digest(removed: DataFrame) -> DataFrame:
    """kept_sha256 in place of kept."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
