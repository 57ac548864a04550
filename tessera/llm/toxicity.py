"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make a document's score.

Labels are of documents, so tokens are labelled from them first, by a lexicon of whole words and of word beginnings
that stand in far more contexts of toxic than of other documents (a likelihood-ratio test at a level that allows for
the number tried). Longer entries come first: a beginning is tested only on words that no longer entry explains, and
counts only if several such words share it. A token of a toxic document is labelled toxic if the lexicon has it.

The lexicon is not seen by the field itself. Its features are hashed: the word, its beginnings and its ending, and the
words before and after. They and the transitions between its two states (other, toxic) are fitted by gradient ascent on
the likelihood of labelled segments. So what a toxic word shares with clean ones carries little weight, and words that
the lexicon lacks are tagged by what they share with those it has. Scoring runs forward and backward over every token
of a whole text, for all texts of a batch at once; a logistic model turns what a text's marginals p add up to into a
score: the sum of p^2, and the sum of -log(1 - p^2), which grows with how sure the field is of a token. Squares keep the
faint marginals of long clean texts from adding up.

Fitting uses bounded samples of labelled rows: at most SAMPLE_TOXIC and SAMPLE_OTHER documents, by the smallest hash of
the id, for the lexicon and the logistic model, and at most SEGMENTS distinct segments of each kind for the field.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_train, saved, small_batches

SAMPLE_TOXIC, SAMPLE_OTHER = 4000, 8000
#: Most segments of SEGMENT words with, and without, a toxic label that the field is fitted on.
SEGMENTS, SEGMENT = 3000, 64
#: Lengths of beginnings in the lexicon, in characters, and how many words have to share one.
BEGINNINGS, SHARED = (7, 6, 5, 4, 3), 4
#: Least log odds of an entry.
LEAST_ODDS = 3.0
#: A token is reported as offending from this marginal on.
OFFENDING = 0.5
#: Hashed features, as a power of two.
BITS = 20
STEPS = 80
#: Words that each Python worker remembers, and tokens that are tagged, and contexts that are held, at once.
REMEMBERED, AT_ONCE, HELD = 100_000, 100_000, 60_000

_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def features_of(word: bytes) -> list[bytes]:
    """The word, its beginnings (which end in `*`) and its ending, in bytes; `<` and `>` before a word are neighbours."""
    return [word, b"*" + word[-3:]] + [word[:n] + b"*" for n in range(3, min(8, len(word)) + 1)]


def _hashed(features: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f) for f in features], np.uint64).astype(np.int64) & ((1 << BITS) - 1)


def _chained(p: np.ndarray, q: np.ndarray, r: np.ndarray, rows: int) -> np.ndarray:
    """v[i] = (p[i] v[i-1] + q[i]) / (r[i] v[i-1] + 1), with 1 before the first.

    Such maps compose as matrices. So the sequence is cut into columns of `rows` elements: the maps of whole columns
    first, then what enters each column, then the columns, each step for all columns at once.
    """
    p, q, r = (np.ascontiguousarray(v.reshape(-1, rows).T) for v in (p, q, r))
    enter = np.ones(p.shape[1])
    if p[0].any() or r[0].any():  # else every column begins with a constant
        a, b, c, d = np.ones_like(enter), np.zeros_like(enter), np.zeros_like(enter), np.ones_like(enter)
        for i in range(rows):
            a, b, c, d = p[i] * a + q[i] * c, p[i] * b + q[i] * d, r[i] * a + c, r[i] * b + d
            if i % 8 == 7:
                most = np.maximum(np.maximum(a, b), np.maximum(c, d))
                a, b, c, d = a / most, b / most, c / most, d / most
        now = 1.0
        for j, (aj, bj, cj, dj) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
            enter[j] = now
            now = (aj * now + bj) / (cj * now + dj)
    out, v = np.empty_like(p), enter
    for i in range(rows):
        v = out[i] = (p[i] * v + q[i]) / (r[i] * v + 1.0)
    return out.T.reshape(-1)


def marginals(e: np.ndarray, first: np.ndarray, moves: tuple[float, ...], rows: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios of toxic over other, and each token's marginal of being toxic.

    e: the potential of toxic over other of each token; first: where a chain begins. rows: see _chained().
    """
    ot, to, tt = np.exp(moves)
    n = len(e)
    if not n:
        return e, e, e
    rows = rows or math.isqrt(n)
    x, cut = np.ones(-(-n // rows) * rows), np.ones(-(-n // rows) * rows, bool)
    x[:n], cut[:n] = e, first
    forward = _chained(np.where(cut, 0.0, x * tt), np.where(cut, x, x * ot), np.where(cut, 0.0, to), rows)
    # going back, the value of a token comes from the token after it; 1 where that begins a chain
    after, ends = np.append(x[1:], 1.0)[::-1], np.append(cut[1:], True)[::-1]
    back = _chained(np.where(ends, 0.0, after * tt), np.where(ends, 1.0, to), np.where(ends, 0.0, after * ot), rows)[::-1]
    forward, back = forward[:n], back[:n]
    odds = forward * back
    return forward, back, odds / (1.0 + odds)


@dataclass
class Model:
    #: of each hashed feature
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -6.0
    #: potentials from other to toxic, toxic to other, toxic to toxic (other to other: 0)
    moves: tuple[float, ...] = (0.0, 0.0, 0.0)
    #: intercept, weights of log(1 + sum of p^2) and of log(1 + sum of -log(1 - p^2))
    scale: tuple[float, ...] = (-4.0, 2.0, 2.0)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to its own potential, to that of the word after it and to that of the word before it."""
        out = np.zeros((len(words), 3))
        for i in range(0, len(words), 5000):  # few features at a time
            some = words[i : i + 5000]
            own = [features_of(w) for w in some]
            out[i : i + 5000, 0] = np.add.reduceat(self.weights[_hashed([f for fs in own for f in fs])].astype(float), np.cumsum([0] + [len(fs) for fs in own])[:-1])
            out[i : i + 5000, 1] = self.weights[_hashed([b"<" + w for w in some])]
            out[i : i + 5000, 2] = self.weights[_hashed([b">" + w for w in some])]
        return out

    def potentials(self, parts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """parts: of_words() of each token in turn."""
        z = self.bias + parts[:, 0]
        z[1:] += np.where(first[1:], 0.0, parts[:-1, 1])
        z[:-1] += np.where(first[1:], 0.0, parts[1:, 2])
        return np.exp(np.clip(z, -30, 30))

    def score(self, squares: np.ndarray, surely: np.ndarray) -> np.ndarray:
        c, w, k = self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(c + w * np.log1p(squares) + k * np.log1p(surely), -40, 40)))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with a hash of the words beside it and the label; repeats are left out as far as they are held."""

    def out(seen) -> pa.RecordBatch:
        words, places, labels = zip(*seen) if seen else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(places, pa.int64()), pa.array(labels, pa.int32())], names=["word", "place", "toxic"])

    seen: set[tuple[bytes, int, int]] = set()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = [b"", *words_of(text), b""]
            for before, w, after in zip(words, words[1:], words[2:]):
                seen.add((w, xxhash.xxh64_intdigest(before + b" " + after) >> 1, toxic))
                if len(seen) >= HELD:
                    yield out(seen)
                    seen.clear()
    yield out(seen)


def _entries(n_other: int, n_toxic: int, tried: int):
    """The entries among some words with their numbers of contexts: whole words first, then shorter and shorter beginnings."""
    base = n_toxic / (n_toxic + n_other)

    def telling(o: int, t: int) -> bool:
        gain = t * math.log(t / (t + o) / base) + (o * math.log(o / (t + o) / (1 - base)) if o else 0.0)
        return gain >= math.log(tried + 1) + 3 and math.log((t + 0.5) / (n_toxic + 1)) - math.log((o + 0.5) / (n_other + 1)) >= LEAST_ODDS

    def run(words: pa.Table) -> pa.Table:
        left = list(zip(words.column("word").to_pylist(), words.column("o").to_pylist(), words.column("t").to_pylist()))
        found = []
        for n in (0, *BEGINNINGS):  # 0: whole words
            sums: dict[str, list[int]] = {}
            for w, o, t in left:
                if len(w) >= n:
                    s = sums.setdefault(w[:n] if n else w, [0, 0, 0])
                    s[0], s[1], s[2] = s[0] + o, s[1] + t, s[2] + (t > 0)
            new = {x for x, (o, t, kinds) in sums.items() if t >= 2 and kinds >= (SHARED if n else 1) and telling(o, t)}
            found += [(x, n) for x in new]
            left = [x for x in left if len(x[0]) < n or (x[0][:n] if n else x[0]) not in new]
        return pa.table([pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], names=["entry", "n"])

    return run


def _lexicon(picked: DataFrame) -> tuple[set[str], set[str]]:
    """Words, and beginnings of words, that have significantly more toxic contexts.

    Documents that are copies of each other, or share passages, aren't independent, so counts are of distinct contexts,
    which copies share and toxic words don't. An entry needs several of them, so the sample bounds their number.
    """
    places = picked.mapInArrow(_contexts, "word string, place bigint, toxic int").distinct()
    words = saved(places.groupBy("word").agg(F.count_if(F.col("toxic") == 0).alias("o"), F.count_if(F.col("toxic") == 1).alias("t")))
    n_other, n_toxic, tried = words.agg(F.coalesce(F.sum("o"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0)), F.count_if(F.col("t") > 1)).first()
    if not n_other or not n_toxic:
        return set(), set()
    # words that share a beginning meet, in one of 64 groups
    together = F.pmod(F.xxhash64(F.substring("word", 1, min(BEGINNINGS))), F.lit(64))
    found = words.groupBy(together).applyInArrow(_entries(n_other, n_toxic, tried), "entry string, n int").collect()
    return {r["entry"] for r in found if not r["n"]}, {r["entry"] for r in found if r["n"]}


def _segments(shared):
    """Segments with a word of the lexicon from toxic documents (kind 1), and all of other documents (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, beginnings = shared.value
        known: dict[bytes, int] = {}

        def listed(word: bytes) -> int:
            w = word.decode("utf-8", "replace")
            return int(w in whole or any(w[:n] in beginnings for n in BEGINNINGS if len(w) >= n))

        def rows(out) -> pa.RecordBatch:
            held = list(out.values())
            return pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.int64()), pa.array([r[0] for r in held], pa.int32()), pa.array([[w.decode("utf-8", "replace") for w in r[1]] for r in held], pa.list_(pa.string())), pa.array([r[2] for r in held], pa.list_(pa.int32()))],
                names=["at", "kind", "words", "flags"],
            )

        out: dict[int, tuple[int, list[bytes], list[int]]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = words_of(text)
                for i in range(0, len(words), SEGMENT):
                    part = words[i : i + SEGMENT]
                    if len(known) > REMEMBERED:
                        known.clear()
                    flags = [known[w] if w in known else known.setdefault(w, listed(w)) for w in part] if toxic else [0] * len(part)
                    if not toxic or any(flags):
                        out[xxhash.xxh64_intdigest(b" ".join(part), toxic) >> 1] = (toxic, part, flags)
                    if len(out) * SEGMENT >= HELD:
                        yield rows(out)
                        out.clear()
        yield rows(out)

    return run


def _many_hashed(words: list[bytes], features) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and the number of the word that each belongs to; a part of the words at a time."""
    hashed, of_word = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i in range(0, len(words), 5000):
        made = [features(w) for w in words[i : i + 5000]]
        hashed.append(_hashed([f for fs in made for f in fs]).astype(np.int32))
        of_word.append(np.repeat(np.arange(i, i + len(made), dtype=np.int32), [len(fs) for fs in made]))
    return np.concatenate(hashed), np.concatenate(of_word)


def _fit_field(segments: pa.Table, steps: int = STEPS) -> Model:
    """Weights of greatest likelihood, less a square penalty, of the labelled segments: words and flags, lists of one length."""
    model = Model()
    # each segment fills SEGMENT places; those left over stand alone and don't count
    tokens = pc.list_flatten(segments.column("words").combine_chunks()).dictionary_encode()
    lengths = pc.list_value_length(segments.column("words")).to_numpy().astype(np.int64)
    place = np.arange(len(tokens)) + np.repeat(np.arange(len(lengths)) * SEGMENT - (np.cumsum(lengths) - lengths), lengths)
    at, y, live = np.zeros(len(lengths) * SEGMENT, np.int64), np.zeros(len(lengths) * SEGMENT), np.zeros(len(lengths) * SEGMENT, bool)
    at[place], y[place], live[place] = tokens.indices.to_numpy(), pc.list_flatten(segments.column("flags").combine_chunks()).to_numpy(), True
    first = ~live
    first[::SEGMENT] = True
    words, linked = [w.encode() for w in tokens.dictionary.to_pylist()], ~first[1:]
    feature, of_word = _many_hashed(words, features_of)
    before, after = _many_hashed(words, lambda w: [b"<" + w])[0], _many_hashed(words, lambda w: [b">" + w])[0]
    used, where = np.unique(np.concatenate((feature, before, after)), return_inverse=True)
    feature, before, after = np.split(where, [len(feature), len(feature) + len(before)])
    n, k = len(words), len(used)
    # the features' weights, the bias, the three moves
    theta = np.zeros(k + 4)
    theta[k] = model.bias
    m, v = np.zeros(k + 4), np.zeros(k + 4)
    prior = np.append(np.full(k, 0.5), (0.0, 0.5, 0.5, 0.5))
    for step in range(1, steps + 1):
        w = theta[:k]
        z = theta[k] + np.bincount(of_word, w[feature], n)[at]
        z[1:] += np.where(linked, w[before][at[:-1]], 0.0)
        z[:-1] += np.where(linked, w[after][at[1:]], 0.0)
        e = np.exp(np.clip(z, -30, 30))
        forward, back, p = marginals(e, first, tuple(theta[k + 1 :]), SEGMENT)
        miss = (y - p) * live
        grad = np.empty(k + 4)
        grad[:k] = np.bincount(feature, np.bincount(at, miss, n)[of_word], k)
        grad[:k] += np.bincount(before, np.bincount(at[:-1][linked], miss[1:][linked], n), k) + np.bincount(after, np.bincount(at[1:][linked], miss[:-1][linked], n), k)
        grad[k] = miss.sum()
        ot, to, tt = np.exp(theta[k + 1 :])
        a, eb = forward[:-1][linked], (e[1:] * back[1:])[linked]
        pairs = np.stack((ot * eb, to * a, tt * a * eb)) / (1.0 + ot * eb + to * a + tt * a * eb)
        u, t = y[:-1][linked], y[1:][linked]
        grad[k + 1 :] = [((1 - u) * t).sum() - pairs[0].sum(), (u * (1 - t)).sum() - pairs[1].sum(), (u * t).sum() - pairs[2].sum()]
        grad -= prior * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.2 * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights[used] = theta[:k]
    model.bias, model.moves = float(theta[k]), tuple(theta[k + 1 :].tolist())
    return model


def _fit_scale(rows: list[tuple[int, float, float]]) -> tuple[float, ...]:
    """Logistic regression of the label on what a document's marginals add up to: (toxic, squares, surely)."""
    x, y = np.array([(1.0, math.log1p(s), math.log1p(m)) for _, s, m in rows]), np.array([t for t, _, _ in rows], float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.02 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.02 * w)
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows that in_train() allows are looked at.

    Without toxic or without other labelled documents, or without a word that tells them apart, the model knows no word
    and scores all texts nearly alike. Of several labels of one id the larger counts; labels other than 0 and 1, null
    ids and ids without a document are left out. Rows of docs that share an id all have its label.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(in_train(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = lambda kind, most: known.where(F.col("toxic") == kind).orderBy(*order).limit(most)
    ids = [(r["doc_id"], r["toxic"]) for r in sample(1, SAMPLE_TOXIC).union(sample(0, SAMPLE_OTHER)).collect()]  # bounded
    if len({t for _, t in ids}) < 2:
        return Model()
    chosen = spark.createDataFrame(ids, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    picked = saved(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    segments = picked.mapInArrow(_segments(spark.sparkContext.broadcast(_lexicon(picked))), "at bigint, kind int, words array<string>, flags array<int>").dropDuplicates(["at"])
    segments = saved(segments)
    counts = {r["kind"]: r["count"] for r in segments.groupBy("kind").count().collect()}
    if not counts.get(1):
        return Model()

    def of_kind(kind: int) -> DataFrame:
        """The SEGMENTS with the smallest hash; a bound on hashes that leaves half as many again keeps others in their tasks."""
        most = 2**63 - 1 if counts.get(kind, 0) <= 2 * SEGMENTS else int(2**63 * 1.5 * SEGMENTS / counts[kind])
        return segments.where((F.col("kind") == kind) & (F.col("at") <= most)).orderBy("at").limit(SEGMENTS).select("words", "flags")

    model = _fit_field(of_kind(1).union(of_kind(0)).toArrow())  # bounded, in words too
    sums = picked.select(F.col("toxic").alias("doc_id"), "text").mapInArrow(_tagged(spark.sparkContext.broadcast(model), _sums), "doc_id int, squares double, surely double")
    model.scale = _fit_scale([tuple(r) for r in sums.collect()])  # three numbers a document of the sample
    return model


class _Words(dict):
    """Word to row of `table`; rows of new words are filled in by settle()."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table, self.fresh = model, np.zeros((0, 3)), []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at

    def parts(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
            self.table = np.zeros((0, 3))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self.table, self.fresh = np.concatenate((self.table, self.model.of_words(self.fresh))), []
        return self.table[at]


_CACHES: dict[int, _Words] = {}


def _tagged(shared, finish):
    """Marginals of every token of every text, and what `finish` makes of them: further columns beside doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if id(model) not in _CACHES:
            _CACHES.clear()
            _CACHES[id(model)] = _Words(model)
        known = _CACHES[id(model)]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            i = 0
            while i < len(texts):
                words, cuts = [], [0]
                while i + len(cuts) - 1 < len(texts) and (len(cuts) == 1 or len(words) < AT_ONCE):
                    words += words_of(texts[i + len(cuts) - 1])
                    cuts.append(len(words))
                part, cuts = slice(i, i + len(cuts) - 1), np.array(cuts)
                first = np.zeros(len(words), bool)
                first[cuts[:-1][cuts[:-1] < len(words)]] = True
                p = marginals(model.potentials(known.parts(words), first), first, model.moves)[2] if words else np.zeros(0)
                made = finish(model, texts[part], p, cuts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(cuts) - 1), *made.values()], names=["doc_id", *made])
                i = part.stop
            if not texts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(made := finish(model, [], np.zeros(0), np.zeros(1, np.int64))).values()], names=["doc_id", *made])

    return run


def _both(p: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of p^2 and of -log(1 - p^2) over each text; 0 for a text without words."""
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    squares, surely = np.zeros(len(cuts) - 1), np.zeros(len(cuts) - 1)
    if len(some):
        p2 = p * p
        squares[some], surely[some] = np.add.reduceat(p2, cuts[some]), np.add.reduceat(-np.log1p(-np.minimum(p2, 1 - 1e-6)), cuts[some])
    return squares, surely


def _sums(model: Model, texts, p: np.ndarray, cuts: np.ndarray) -> dict[str, pa.Array]:
    squares, surely = _both(p, cuts)
    return {"squares": pa.array(squares), "surely": pa.array(surely)}


def _scores(model: Model, texts, p: np.ndarray, cuts: np.ndarray) -> dict[str, pa.Array]:
    return {"score": pa.array(model.score(*_both(p, cuts)))}


def _scores_and_spans(model: Model, texts, p: np.ndarray, cuts: np.ndarray) -> dict[str, pa.Array]:
    spans = []
    for text, a, b in zip(texts, cuts, cuts[1:]):
        at = np.flatnonzero(p[a:b] >= OFFENDING).tolist()
        spans.append([{**s, "marginal": float(p[a + i])} for s, i in zip(_spans(text, at), at)] if at else [])
    return _scores(model, texts, p, cuts) | {"spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])))}


def _spans(text: str, at: list[int]) -> list[dict]:
    """Code-point offsets of the words numbered `at`. Lower-casing that changes lengths is undone per character."""
    low = [c.lower() for c in text]
    raw = "".join(low).encode("utf-8", "surrogatepass").translate(_LETTERS)
    words, starts, i = raw.split(), [], 0
    for w in words:
        i = raw.index(w, i)
        starts.append(i)
        i += len(w)
    sizes = np.cumsum([0] + [len(c.encode("utf-8", "surrogatepass")) for c in low])
    return [{"start": int(np.searchsorted(sizes, starts[k], "right")) - 1, "end": int(np.searchsorted(sizes, starts[k] + len(words[k]), "left"))} for k in at if k < len(words)]


def score(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, score, and spans of offending words (code points, marginal).

    Whole texts are read. Null, empty and wordless texts have no marginals and get the score of a text without toxic
    words. Rows alike get the same score and are kept each. Other columns are not read. Empty table: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", spans array<struct<start:bigint,end:bigint,marginal:double>>" if with_spans else ""
    return docs.select("doc_id", "text").mapInArrow(_tagged(spark.sparkContext.broadcast(model), _scores_and_spans if with_spans else _scores), f"doc_id {kind}, score double{more}")


def reject(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns kept, whose text scores below `least`. Nulls, ties and repeats: as score()."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagged = _tagged(shared, _scores)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column("text")], names=["doc_id", "text"])
            scores = np.concatenate([b.column("score").to_numpy() for b in tagged(iter([texts]))])
            yield batch.filter(pa.array(scores < least))

    return docs.mapInArrow(run, docs.schema)
