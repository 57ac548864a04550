"""Language identification that looks words up first and backs off to shorter and shorter character n-grams.

Per language, the model holds log relative frequencies of words and of n-grams (of words with a mark at both
ends). A known word scores by its frequency in each language. For an unseen word, n goes down from MOST_N: at
the first n for which any n-gram of the word is known in any language, the word scores the mean over those
n-grams. What a language lacks costs it a fixed penalty. A text's score is the mean over its words.

The model is fitted on at most SAMPLE labelled rows a language, those with the smallest hash of the id, and on no more
than SAMPLE_BYTES of their texts (the last one whole). Of what they hold, the model keeps at most ENTRIES frequencies: each
language's most frequent words and n-grams of each length, an equal share each. So neither the driver nor a worker
holds more, however many languages there are; only pairs of a gram and a language that has it take room.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_train, saved, small_batches

#: Most labelled rows of each language that the model is fitted on.
SAMPLE = 2500
#: Bytes of those rows' texts after which no further row is taken.
SAMPLE_BYTES = 16 << 20
#: Least times that a word or n-gram occurs in the sample to be known.
LEAST = 2
MOST_N = 5
#: Most frequencies in the model, over all languages (some 150 bytes each in every Python worker).
ENTRIES = 1_500_000
#: Lower log10 frequency than any that a sample of this size has.
PENALTY = -7.0
#: Unseen words that each Python worker remembers.
REMEMBERED = 300_000
#: Words that are looked up at once; what is remembered may be forgotten between two such parts.
PART = 10_000
#: Ranges of the hash of an id, as a power of two.
_RANGE_BITS = 12

_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters; every character beyond ASCII counts as one."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def has_letter(text: str | None, words: list[bytes]) -> bool:
    if not words:
        return False
    return any(w.isascii() for w in words) or any(c.isalpha() for c in text)


def grams(word: bytes, n: int) -> list[str]:
    padded = f"\x02{word.decode('utf-8', 'replace')}\x03"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n = 0: words; else n-grams of that length."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
    for lang, words in counts.items():
        for n in range(MOST_N + 1):
            if n:
                total = Counter()
                for w, c in words.items():
                    for g in grams(w, n):
                        total[g] += c
                items = list(total.items())
            else:
                items = [(w.decode("utf-8", "replace"), c) for w, c in words.items()]
            for i in range(0, len(items), 20_000):
                part = items[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array([k for k, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64())], names=["lang", "n", "gram", "count"])


class Model:
    """Log10 relative frequencies of words (by bytes) and n-grams (by length and string), as gains over PENALTY.

    Each word or n-gram has a row; row i's gains are those from start[i] to start[i + 1], one for each language that has it.
    """

    def __init__(self, counts: pa.Table):
        """counts: lang, n, gram, count, total (of the language and n)."""
        names = counts.column("lang").to_pylist()
        self.langs = sorted(set(names))
        number = {lang: i for i, lang in enumerate(self.langs)}
        lang = np.fromiter((number[x] for x in names), np.int32, len(names))
        self.words: dict[bytes, int] = {}
        self.grams: dict[tuple[int, str], int] = {}
        row = np.zeros(len(names), np.int64)
        for i, (n, gram) in enumerate(zip(counts.column("n").to_pylist(), counts.column("gram").to_pylist())):
            rows, key = (self.grams, (n, gram)) if n else (self.words, gram.encode())
            row[i] = rows.setdefault(key, len(self.grams) + len(self.words))
        gain = np.maximum(0.0, np.log10(counts.column("count").to_numpy() / counts.column("total").to_numpy()) - PENALTY)
        order = np.lexsort((lang, row))
        self.lang, self.gain = lang[order], gain[order].astype(np.float32)
        self.start = np.searchsorted(row[order], np.arange(len(self.grams) + len(self.words) + 1))

    def unseen(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The languages in which an unseen word gains, and what."""
        for n in range(MOST_N, 0, -1):
            found = [i for g in grams(word, n) if (i := self.grams.get((n, g))) is not None]
            if found:
                at = np.concatenate([np.arange(self.start[i], self.start[i + 1]) for i in found])
                gain = np.bincount(self.lang[at], self.gain[at], len(self.langs)) / len(found)
                langs = np.flatnonzero(gain)
                return langs, gain[langs]
        return np.zeros(0, np.int64), np.zeros(0)


def fit(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST, entries: int = ENTRIES) -> Model:
    """From doc_id, text and lang of rows with neither null. Rows that share an id are taken or left together."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # counts by range of the hash tell where a language's sample ends, so only rows up to there are ranked
    at = F.xxhash64("doc_id")
    ranges = rows.groupBy("lang", F.shiftright(at, 64 - _RANGE_BITS).alias("range")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("range")) - F.col("n")
    last = ranges.withColumn("before", before).where(F.col("before") < sample).groupBy("lang").agg(F.max("range").alias("last"))
    few = rows.select("doc_id", "lang", at.alias("at"), F.octet_length("text").cast("long").alias("size")).join(F.broadcast(last), "lang").where(F.shiftright("at", 64 - _RANGE_BITS) <= F.col("last"))
    order = Window.partitionBy("lang").orderBy("at", "doc_id")
    chosen = few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    sizes = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.withColumn("before_bytes", F.coalesce(sizes, F.lit(0))).where(F.col("before_bytes") < SAMPLE_BYTES)
    ids = chosen.select("doc_id").distinct()  # at most `sample` a language
    picked = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "lang")
    counts = picked.mapInArrow(_counted, "lang string, n int, gram string, count bigint").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    totals = Window.partitionBy("lang", "n")
    known = saved(counts.withColumn("total", F.sum("count").over(totals)).where(F.col("count") >= least))
    share = entries // max(1, known.select("lang", "n").distinct().count())
    frequent = Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram")
    kept = known.withColumn("place", F.row_number().over(frequent)).where(F.col("place") <= share)
    return Model(kept.select("lang", "n", "gram", "count", "total").toArrow())


class _Rows(dict):
    """Word to row: known words, and unseen ones as they come, with their gains behind those of the model."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.known, self.used = model, len(model.start) - 1, len(model.lang)
        self.start = np.concatenate((model.start, np.zeros(REMEMBERED, np.int64)))
        self.lang, self.gain = model.lang, model.gain
        self.n = 0

    def __missing__(self, word: bytes) -> int:
        lang, gain = self.model.unseen(word)
        end = self.used + len(lang)
        if end > len(self.lang):
            room = len(self.lang) // 2 + len(lang)
            self.lang, self.gain = np.concatenate((self.lang, np.zeros(room, np.int32))), np.concatenate((self.gain, np.zeros(room, np.float32)))
        self.lang[self.used : end], self.gain[self.used : end] = lang, gain
        row = self[word] = self.known + self.n
        self.n += 1
        self.used = self.start[row + 1] = end
        return row

    def gains(self, words: list[bytes]) -> np.ndarray:
        """Of each language, over at most PART words."""
        if self.n + len(words) > REMEMBERED or self.used > len(self.model.lang) + 4 * REMEMBERED:
            for w in [w for w, i in self.items() if i >= self.known]:
                del self[w]
            self.n, self.used = 0, len(self.model.lang)
        rows = np.array(list(map(self.__getitem__, words)), np.int64)
        first = self.start[rows]
        sizes = self.start[rows + 1] - first
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.lang[at], self.gain[at], len(self.model.langs))


_SEEN: dict[int, _Rows] = {}


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rows = _SEEN.get(id(model))
        if rows is None:
            _SEEN.clear()
            rows = _SEEN[id(model)] = _Rows(model)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if not has_letter(text, words) or not model.langs:
                    langs.append("und"), scores.append(0.0)
                    continue
                total = sum(rows.gains(words[i : i + PART]) for i in range(0, len(words), PART)) / len(words)
                odds = 10 ** (total - total.max())
                best = int(np.argmax(total))
                langs.append(model.langs[best]), scores.append(float(odds[best] / odds.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, lang_pred, score.

    score: the best language's share of 10 to the power of each language's mean over the words, so it tells how far
    apart languages are for a typical word of the text, however long that is.

    Whole texts are read. Null, empty and letterless texts, and all texts if the model knows no language, get
    `und` with score 0. Of languages with the same score the first by name is taken. Repeated rows are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"doc_id {kind}, lang_pred string, score double")


def train_and_identify(docs: DataFrame) -> DataFrame:
    """Fits on rows that in_train() allows; adds held_out."""
    return identify(docs, fit(docs.where(in_train(F.col("doc_id"))))).withColumn("held_out", ~in_train(F.col("doc_id")))
