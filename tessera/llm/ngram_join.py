"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's tokens are the hashes of its distinct word shingles. Documents with the same set are one class;
classes are what is joined. Two sets of similarity t or more share a token among the first
|x| - ceil(t |x|) + 1 of each, whatever the global order of tokens; so a pair must share a prefix token under
each of ORDERS orders, and the filters are intersected before sets are compared. All orders put tokens that a
count-min sketch estimates as frequent last, and differ by a seeded hash among the rest.

Tokens whose estimate is 1 occur in one text, so they take up places in a prefix but are never joined on;
a class without a repeated token in every prefix links with nothing. This keeps most documents out of the join.
The sketch counts finely and keeps a bit for cells side by side, so it fills with repeated tokens, not with all.

A shared prefix token at places i and j says that the overlap is at most min(|x| - i, |y| - j) if it is the first
one shared, so a pair is only made by tokens where that is enough (for equal sizes: the first ninth of a set).

Links are wanted up to components, so not every pair of a large group is compared. First each class is
compared with a leader of each of its prefix tokens, among those of about its size: the class with the fewest
tokens of its own, which is the likeliest to link. Then tokens whose classes lie in one component have nothing
left to tell; for the others the pairs of about one size across components are compared. A link between two texts is
thereby either compared or already implied. Rows of hot tokens are dealt over salts in every join by token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .common import blocks, lowered, mix, removed, rolling, saved, small_batches, utf8, word_hashes, word_spans, written
from .components import components

SHINGLE = 5
PERCENT = 80
ORDERS = 3
#: Estimated occurrences from which a token counts as frequent in the orders.
HOT = 32
#: Hash buckets of tokens by which hot ones are found, and how many times the mean a bucket holds before it is dealt.
BUCKETS, HEAVY = 65_536, 8
#: Most nodes (16 bytes each) that are broadcast.
BROADCAST = 200_000
#: Tasks over which the classes of a component are dealt.
SALTS = 8
_FLUSH = 200_000


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of rows: first row, tokens of all rows (sorted and distinct within each), n + 1 offsets."""
    data, offs = utf8(texts)
    for i, j in blocks(offs):
        part, at = lowered(data[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
        starts, ends, rows = word_spans(part, at)
        words = word_hashes(part, starts, ends)
        first, tokens = rolling(words, rows, k)
        row = rows[first]
        n_words = np.bincount(rows, minlength=j - i)
        for short in range(1, k):  # the whole of a shorter text is one token
            few = np.flatnonzero(n_words[rows] == short)
            if len(few):
                f, h = rolling(words[few], rows[few], short)
                tokens, row = np.concatenate((tokens, mix(h, short))), np.concatenate((row, rows[few][f]))
        order = np.lexsort((tokens, row))
        tokens, row = tokens[order], row[order]
        if len(tokens):
            new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])))
            tokens, row = tokens[new], row[new]
        yield i, tokens, np.searchsorted(row, np.arange(j - i + 1))


def _set_keys(tokens: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each row's set: two sums of mixed tokens."""
    sums = []
    for seed in (101, 202):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens, seed))))
        sums.append(mix(run[cuts[1:]] - run[cuts[:-1]], seed))
    return sums[0], sums[1]


def _tokens(k: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, tokens, _ in _sets(batch.column("text"), k):
            yield tokens

    return run


_FEATURES = "n_shingles bigint, node binary, prefix array<bigint>, others array<array<int>>, tokens array<bigint>"


def _features(seen, k: int, percent: int, orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, sent = seen.value, set()
        for batch in batches:
            nodes, counts, prefixes, others, kept = [], [], [], [], []
            for _, tokens, cuts in _sets(batch.column("text"), k):
                k1, k2 = _set_keys(tokens, cuts)
                repeated = maybe(tokens)
                for r in range(len(cuts) - 1):
                    a, b = cuts[r], cuts[r + 1]
                    n = int(b - a)
                    counts.append(n)
                    node = k1[r].tobytes() + k2[r].tobytes()
                    nodes.append(node if n else None)
                    mine, multi = tokens[a:b], repeated[a:b]
                    p = n - (percent * n + 99) // 100 + 1
                    # the prefix must reach beyond the tokens that occur once, or nothing can be shared
                    if not n or n - int(multi.sum()) >= p or node in sent:
                        prefixes.append(None), others.append(None), kept.append(None)
                        continue
                    if len(sent) >= _FLUSH:
                        sent.clear()
                    sent.add(node)
                    own = mine[multi]
                    room = p - (n - len(own))  # tokens that occur once come first in every order
                    hot = maybe.hot(own)
                    by_order = [own[np.lexsort((mix(own, 1000 + o), hot))[:room]] for o in range(orders)]
                    prefixes.append(by_order[0].view(np.int64))
                    others.append([x.astype(np.uint32).view(np.int32) for x in by_order[1:]])
                    kept.append(own.view(np.int64))
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(prefixes, longs), pa.array(others, pa.list_(ints)), pa.array(kept, longs)],
                names=["doc_id", "n_shingles", "node", "prefix", "others", "tokens"],
            )

    return run


def _compared(pairs: DataFrame, classes: DataFrame, percent: int, orders: int) -> DataFrame:
    """The links among distinct pairs (u < v): the other orders' prefixes first (cut to 32 bits), then the sets.

    Where the pairs have few nodes, only the classes of these are shuffled.
    """
    nodes = saved(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    if nodes.count() <= BROADCAST:
        classes = classes.join(F.broadcast(nodes), "node", "left_semi")
    heads = classes.select("node", "n_shingles", "others")
    a = heads.select(F.col("node").alias("u"), F.col("n_shingles").alias("nu"), F.col("others").alias("pu"))
    b = heads.select(F.col("node").alias("v"), F.col("n_shingles").alias("nv"), F.col("others").alias("pv"))
    both = pairs.join(a, "u").join(b, "v").where((F.col("nu") * 100 >= F.col("nv") * percent) & (F.col("nv") * 100 >= F.col("nu") * percent))
    for o in range(orders - 1):
        both = both.where(F.arrays_overlap(F.col("pu")[o], F.col("pv")[o]))
    sets = classes.select("node", "tokens")
    left = sets.select(F.col("node").alias("u"), F.col("tokens").alias("tu"))
    right = sets.select(F.col("node").alias("v"), F.col("tokens").alias("tv"))
    full = both.select("u", "v", "nu", "nv").join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("tu", "tv"))
    return full.withColumn("shared", shared).where(F.col("shared") * 100 >= (F.col("nu") + F.col("nv") - F.col("shared")) * percent).select("u", "v")


def _salted(posts: DataFrame) -> DataFrame:
    """Adds salt and parts: rows of tokens that much is known to share a hash bucket of are dealt over `parts` salts.

    Rows are counted by BUCKETS buckets of tokens, so the broadcast table has at most that many rows; a bucket that
    holds HEAVY times as many rows as the mean (and 1,000 at least) is dealt. All other tokens have one salt.
    """
    bucket = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")
    sizes = posts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    most = F.greatest(F.lit(1000), F.lit(HEAVY) * F.sum("c").over(Window.partitionBy(F.lit(1))) / BUCKETS)
    heavy = saved(sizes.select("bucket", F.ceil(F.col("c") / most).cast("int").alias("parts")).where("parts > 1"))
    dealt = posts.withColumn("bucket", bucket).join(F.broadcast(heavy), "bucket", "left").drop("bucket")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1)))
    return dealt.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def _every_salt() -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")


def features(texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS) -> tuple[DataFrame, Broadcast]:
    """texts: doc_id, text. Adds n_shingles, node (the set's key; null: empty) and, for rows whose set may link, prefix, others, tokens.

    prefix: the repeated tokens of the first order's prefix; others: those of the other orders, cut to 32 bits; tokens: all
    repeated ones. A task has them once for a set that comes again soon. With the frame comes the sketch that it reads.
    """
    spark = texts.sparkSession
    seen = spark.sparkContext.broadcast(sketch.repeated_finely(texts.select("text"), _tokens(shingle), sketch.text_bytes(texts) / 6.4, HOT))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(_features(seen, shingle, percent, orders), f"doc_id {kind}, {_FEATURES}"), seen


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Sets are distinct shingles of `shingle` words, A-Z lower-cased; a shorter text is one shingle, whole. Two
    rows link when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable by
    links, the row's own included. Null, empty and wordless texts have an empty set and link with nothing.
    Repeated rows link with each other; rows that share a doc_id are told apart by their sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made, seen = features(docs.select("doc_id", "text"), shingle, percent, orders)
    made, wide = written(made)
    seen.unpersist()

    # one row a class; those with a repeated token in every prefix
    classes, at_classes = written(made.where("tokens IS NOT NULL").drop("doc_id").dropDuplicates(["node"]))
    rows = saved(made.select("doc_id", "n_shingles", "node"))
    removed(spark, wide)
    own = F.col("n_shingles") - F.size("tokens")  # tokens that occur once; they hold the first places
    posts = classes.select("node", F.col("n_shingles").alias("n"), own.alias("own"), F.posexplode("prefix").alias("at", "token"))
    # sets whose sizes allow a link lie in one band or in two that follow each other
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int")
    posts = posts.select("token", "node", "n", "own", (F.col("own") + F.col("at")).alias("at"), band.alias("band"))
    posts = _salted(posts)
    shared = posts.groupBy("token", "parts").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token", _every_salt())
    posts = saved(posts.join(shared, ["token", "salt"], "left_semi"))

    def may_link(n, m, i, j) -> F.Column:
        """Sizes n and m, and a first shared token at places i and j, leave room for a link."""
        least = F.ceil((n + m) * percent / (100 + percent))
        return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (n - i >= least) & (m - j >= least)

    leads = posts.groupBy("token", "parts", "band").agg(F.min(F.struct("own", "node", "n", "at")).alias("lead")).select("token", "band", "lead", _every_salt())
    near = posts.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    stars = near.join(leads, ["token", "band", "salt"]).where((F.col("node") != F.col("lead.node")) & may_link(F.col("n"), F.col("lead.n"), F.col("at"), F.col("lead.at")))
    stars = saved(stars.select(F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v")).distinct())
    links = saved(_compared(stars, classes, percent, orders))
    found = components(links)

    # every pair across components of the tokens that still have more than one
    placed = posts.join(found, "node", "left").select("token", "salt", "parts", "band", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("token", "parts").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("token", _every_salt())
    placed = saved(placed.join(mixed, ["token", "salt"], "left_semi"))
    # bands hold sizes that may link; u is dealt by its salt, v meets every salt of the token
    x = placed.select("token", "band", "salt", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("at").alias("iu"), F.col("root").alias("ru"))
    y = placed.select("token", "parts", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("node").alias("v"), F.col("n").alias("nv"), F.col("at").alias("iv"), F.col("root").alias("rv"))
    y = y.select("token", "band", _every_salt(), "v", "nv", "iv", "rv")
    across = x.join(y, ["token", "band", "salt"]).where((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & may_link(F.col("nu"), F.col("nv"), F.col("iu"), F.col("iv")))
    across = saved(across.select("u", "v").distinct().join(stars, ["u", "v"], "left_anti"))
    rest = saved(_compared(across, classes, percent, orders))
    removed(spark, at_classes)
    roots = components(links.union(rest)) if rest.limit(1).count() else found

    members = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a large component is dealt over salts; a class alone needs no join
    lowest = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lowest = lowest.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(lowest, ["root", "salt"], "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
