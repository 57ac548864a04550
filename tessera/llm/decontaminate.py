"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the benchmark, one scan of each text.

Texts and items are normalised alike on their UTF-8 bytes: A-Z to lower case, every other ASCII byte that is
no digit or letter to a space, and cut into words. Each word of the benchmark has a number of a few digits, all other
words share one that no pattern has, and the automaton's patterns are the digits of each window's words. So a match is
a run of whole words, and states are few. Words keep their offsets in the original text, and matches are reported there too.

An automaton is built once in each Python worker, from at most PART_BYTES of items. A larger benchmark is dealt by item
over several automata. One scan then looks each text's windows up, by 64-bit hashes, among those of all parts, and only
texts that may hold a window go on, each to the automata of the parts in question: dealt by ranges of part and key, so
that a task builds few automata and a part that many texts hold is spread over tasks. Findings meet by key, without
texts. A hash that two windows share costs a look at the automaton, never a result. Items pass the driver one part at a
time, hashes in slices of at most NEEDLES; a benchmark with more of them costs one scan of the texts a slice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, rolling, saved, small_batches, utf8, word_hashes, word_spans

WINDOW = 10
#: Base of the words' numbers: a state has at most so many ways on.
BASE = 32
#: Most bytes of items in one automaton, which takes some 240 times as much memory in each Python worker.
PART_BYTES = 1_000_000
#: Most hashes of windows in one lookup, of 13 bytes each in a Python worker (some 50 MB of benchmark).
NEEDLES = 1 << 23

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Windows:
    """The automaton of all windows of some items, each with the ids of the items that hold it."""

    def __init__(self, items: list[tuple[str, str | None]], k: int):
        texts = [(item, normal_words(text)) for item, text in sorted(items, key=lambda x: x[0])]
        numbers: dict[bytes, int] = {}
        for _, words in texts:
            for w in words:
                numbers.setdefault(w, len(numbers))
        self.digits = 1
        while BASE**self.digits < len(numbers):
            self.digits += 1
        # the n-th digits of all words have characters of their own, so a match begins and ends with a word
        self.codes = {w: "".join(chr(1 + BASE * d + n // BASE**d % BASE) for d in range(self.digits)) for w, n in numbers.items()}
        self.other = "\0" * self.digits
        windows: dict[str, tuple[int, list[str]]] = {}
        for item, words in texts:
            code = "".join(map(self.codes.__getitem__, words))
            for i in range(max(1, len(words) - k + 1) if words else 0):
                ids = windows.setdefault(code[i * self.digits : (i + k) * self.digits], (min(k, len(words)), []))[1]
                if not ids or ids[-1] != item:
                    ids.append(item)
        self.found = ahocorasick.Automaton()
        for code, held in windows.items():
            self.found.add_word(code, held)
        self.any = bool(windows)
        if self.any:
            self.found.make_automaton()

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """First word, end and item ids of each window that occurs."""
        if self.any and words:
            for last, (n, ids) in self.found.iter("".join(map(self.codes.get, words, repeat(self.other)))):
                end = (last + 1) // self.digits
                yield end - n, end, ids


_BUILT: dict[str, Windows] = {}


def _windows(key: str, items: Broadcast, k: int) -> Windows:
    """Built once in each Python worker; the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Windows(items.value, k)
    return _BUILT[key]


def _dealt(benchmark: DataFrame, most: int) -> tuple[DataFrame, int]:
    """item_id (as a string), text and part, dealt by hash into parts of about `most` bytes, and their number; an item stays whole."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most)
    return items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))).cast("int")), n


def _parts(items: DataFrame, n: int) -> dict[int, tuple[str, Broadcast]]:
    """Of each part that has items, these as a broadcast with a key of its own."""
    sc = items.sparkSession.sparkContext
    ordered = items.repartitionByRange(n, "part").sortWithinPartitions("part").toLocalIterator() if n else ()
    return {part: (uuid.uuid4().hex, sc.broadcast([(str(r["item_id"]), r["text"]) for r in rows])) for part, rows in groupby(ordered, lambda r: r["part"])}


def _original(text: str, words: list[bytes], runs: list[list[int]]) -> list[dict]:
    """Code-point spans in the text itself of runs of words (first, end exclusive)."""
    raw = text.encode("utf-8", "surrogatepass")
    clean, at, spans = raw.translate(_TABLE), 0, []
    starts = []
    for w in words:
        at = clean.index(w, at)
        starts.append(at)
        at += len(w)
    done, chars = 0, 0
    for i, j in runs:
        a, b = starts[i], starts[j - 1] + len(words[j - 1])
        start = chars + len(raw[done:a].decode("utf-8", "surrogatepass"))
        done, chars = b, start + len(raw[a:b].decode("utf-8", "surrogatepass"))
        spans.append({"start": start, "end": chars, "word": i, "word_end": j})
    return spans


def _merged(runs) -> list[list[int]]:
    """Runs that overlap or touch as one."""
    out: list[list[int]] = []
    for i, j in sorted(runs):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("word_end", pa.int64())]))
_OUT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint,word:bigint,word_end:bigint>>"


def _scan(key: str, items: Broadcast | None, k: int):
    """Adds the findings in each text to the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(key, items, k) if items else None
        for batch in batches:
            n_words, n_hit, found, spans = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = normal_words(text)
                n_words.append(len(words))
                hits = list(windows.hits(words)) if windows else []
                runs = _merged({(i, j) for i, j, _ in hits})
                n_hit.append(sum(j - i for i, j in runs))
                found.append(sorted({x for _, _, ids in hits for x in ids}))
                spans.append(_original(text, words, runs) if runs else [])
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, _SPAN)], names=[*rest.schema.names, "n_words", "n_hit", "items", "spans"])

    return run


_NORMAL = np.frombuffer(_TABLE, np.uint8)


def _runs(column: pa.Array, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]]:
    """By blocks of texts: the first row, each row's number of words, and for each length the rows (in the block) and hashes of all runs of so many words."""
    data, offs = utf8(column)
    for i, j in blocks(offs):
        body = _NORMAL[data[offs[i] : offs[j]]]
        starts, ends, rows = word_spans(body, offs[i : j + 1] - offs[i])
        hashes = word_hashes(body, starts, ends)
        each = ((n, rows[first], found) for n in lengths for first, found in [rolling(hashes, rows, n)])
        yield i, np.bincount(rows, minlength=j - i), each


def _needles(k: int):
    """Hash, length and part of each window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            for i, words, runs in _runs(batch.column("text"), list(range(1, k + 1))):
                for n, rows, hashes in runs:
                    held = words[rows] >= k if n == k else words[rows] == n
                    parts = part[i + rows[held]]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[held].view(np.int64)), pa.array(np.full(len(parts), n, np.int32)), pa.array(parts, pa.int32())], names=["hash", "length", "part"])

    return run


class Needles:
    """Sorted hashes of windows with their parts, behind one bit for each value of the hashes' first bits."""

    def __init__(self, needles: pa.Table):
        hashes = needles.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.parts = hashes[order], needles.column("part").to_numpy()[order]
        self.lengths = np.unique(needles.column("length").to_numpy()).tolist()
        self.bits = max(10, int(8 * len(hashes)).bit_length())
        self.first = np.zeros(1 << (self.bits - 3), np.uint8)
        at = self._at(self.hashes)
        np.bitwise_or.at(self.first, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, rows: np.ndarray, hashes: np.ndarray) -> set[tuple[int, int]]:
        """Rows and parts of the hashes that are among the needles."""
        at = self._at(hashes)
        near = np.flatnonzero(self.first[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        rows, hashes = rows[near], hashes[near]
        start, end = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        return {(int(r), int(p)) for r, i, j in zip(rows, start, end) if i < j for p in self.parts[i:j]}


def _may_hold(shared: Broadcast, whole: bool):
    """Adds n_words and the parts of which a window may occur; text stays where there are any. Other rows are left out unless whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles = shared.value
        for batch in batches:
            text = batch.column("text")
            n_words, parts = np.zeros(len(batch), np.int64), [set() for _ in range(len(batch))]
            for i, words, runs in _runs(text, needles.lengths):
                n_words[i : i + len(words)] = words
                for _, rows, hashes in runs:
                    for row, part in needles.found(rows, hashes):
                        parts[i + row].add(part)
            held = pa.array([bool(p) for p in parts], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("key"), pc.if_else(held, text, None), pa.array(n_words), pa.array([sorted(p) for p in parts], pa.list_(pa.int32()))], names=["key", "text", "n_words", "parts"])
            yield out if whole else out.filter(held)

    return run


def _scan_parts(parts: dict[int, tuple[str, Broadcast]], k: int):
    """Each text by the automaton of its row's part; rows come in order of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    yield from _scan(*parts[int(part[i])], k)(iter([batch.slice(i, j - i).drop_columns(["part"])]))

    return run


def _by_parts(docs: DataFrame, items: DataFrame, n: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Key and n_words of each row of docs, and key, n_hit, items and spans (of one part a row) of the texts with hits."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    parts = _parts(items, n)
    needles = saved(items.select("text", "part").mapInArrow(_needles(k), "hash bigint, length int, part int").distinct())
    slices = max(1, -(-needles.count() // NEEDLES))
    rows, scans = docs.select(_key().alias("key"), "text"), []
    for i in range(slices):
        shared = spark.sparkContext.broadcast(Needles(needles.where(F.pmod("hash", F.lit(slices)) == i).toArrow()))
        found = rows.mapInArrow(_may_hold(shared, i == 0), f"key struct<doc_id:{kind},a:bigint,b:bigint>, text string, n_words bigint, parts array<int>")
        scans.append(found.withColumn("slice", F.lit(i)))
    seen = saved(reduce(DataFrame.union, scans))
    texts = seen.select("key", "text", F.explode("parts").alias("part")).repartitionByRange("part", F.xxhash64("key")).sortWithinPartitions("part")
    hits = texts.mapInArrow(_scan_parts(parts, k), f"key struct<doc_id:{kind},a:bigint,b:bigint>, {_OUT}").where("n_hit > 0")
    return seen.where("slice = 0").select("key", "n_words"), hits.select("key", "items", "spans")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The findings of all parts in one document as those of one automaton: runs that meet are joined."""
    for batch in batches:
        n_hit, items, spans = [], [], []
        for found, parts in zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist()):
            found, parts = found or [], parts or []
            start, end = ({s[w]: s[c] for p in parts for s in p} for w, c in (("word", "start"), ("word_end", "end")))
            runs = _merged((s["word"], s["word_end"]) for p in parts for s in p)
            n_hit.append(sum(j - i for i, j in runs))
            items.append(sorted({x for p in found for x in p}))
            spans.append([{"start": start[i], "end": end[j], "word": i, "word_end": j} for i, j in runs])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN)], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def _key() -> F.Column:
    return F.struct("doc_id", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, n_hit, items, spans.

    items: sorted ids (as strings) of the items of which a window occurs; spans: merged runs of hit words, as
    code points of the original text and as words. Null or empty texts have no words; items without words
    have no window. With an empty benchmark nothing is hit. Repeated rows are reported each, and rows of the benchmark
    that share an id are one item. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    dealt, n = _dealt(benchmark, part_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if n <= 1:
        key, items = _parts(dealt, n).get(0, ("", None))
        return docs.select("doc_id", "text").mapInArrow(_scan(key, items, k), f"doc_id {kind}, {_OUT}")
    rows, hits = _by_parts(docs, dealt, n, k)
    # rows alike in id and text have the same findings, so sets hold one entry a part however many there are
    sets = hits.groupBy("key").agg(F.collect_set("items").alias("items"), F.collect_set("spans").alias("spans"))
    return rows.join(sets, "key", "left").select("key.doc_id", "n_words", "items", "spans").mapInArrow(_together, f"doc_id {kind}, {_OUT}")


def clean(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs, all columns kept, whose text holds no window of the benchmark.

    Null and empty texts hold none and stay, repeated rows stay or go alike, and an empty benchmark leaves all.
    """
    small_batches(docs.sparkSession)
    dealt, n = _dealt(benchmark, part_bytes)
    if not n:
        return docs
    if n > 1:
        dirty = _by_parts(docs, dealt, n, k)[1].select("key").distinct()
        packed = docs.select(_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        return packed.join(dirty, "key", "left_anti").select("row.*")
    key, items = _parts(dealt, n)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(key, items, k)
        for batch in batches:
            yield batch.filter(pa.array([next(windows.hits(normal_words(t)), None) is None for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
