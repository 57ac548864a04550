"""A trie of conversations' prefixes by distributed most-significant-digit radix partitioning.

Turns become numbers first: a dictionary gives each distinct turn (role and text, by 128 bits of a hash) an id, and a
conversation is the array of its turns' ids. Equal arrays are one class with a count, its smallest conversation and the
digest of its members, so that copies cost one row.

The recursion deals classes into buckets, by the node they have reached and the next turn's id. A bucket of few classes
goes to a task, which sorts it by multikey quicksort and emits a node for every part that the recursion enters. A
larger bucket stays distributed: its least and greatest arrays give the prefix that all its classes share, so one round
emits that whole chain of nodes, however long, and deals the classes by the turn that comes after it. Only large buckets
take part in the next round. Sums over subtrees come back from the last round to the first.

A node is named by its depth and its smallest conversation: each conversation has one prefix of each length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Most classes, and most turns of them, that a task finishes at once; a single class is always local.
LOCAL_CLASSES, LOCAL_TURNS = 256, 65_536
#: Most rows of a dictionary, or of the large buckets of a round, that are broadcast (some 100 bytes each).
BROADCAST = 100_000
#: Conversations whose ids are joined into one piece before a class's digest is taken.
CHUNK = 65_536

_CLASS = "ids array<bigint>, sizes array<bigint>, n bigint, conv bigint, ends string"
_NODE = "conv bigint, depth bigint, parent bigint, n bigint, children bigint, leaves bigint, saved bigint, ends string, top boolean"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encoded(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of struct(id, size) in order of turn (null first), role and the hash of the text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.length(text).cast("long").alias("size"))
    dictionary = saved(turns.select("key").distinct()).withColumn("id", F.monotonically_increasing_id())
    coded = turns.join(F.broadcast(dictionary) if dictionary.count() <= BROADCAST else dictionary, "key")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "key", "id", "size")))
    return coded.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def with_heads(convs: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every; h is crc32 of the id modulo `heads`."""
    c = F.col("conv_id")
    base, h = c - c % every, (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    first = convs.where(c % every == 0).select(c.alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    joined = convs.withColumn("base", base).join(first, "base", "left").withColumn("h", h)
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(F.slice("turns", 1, 0))
    return joined.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", 1, F.col("h")), own)).alias("turns"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of classes to classes; the digest runs over a class's pieces without holding them."""
    now, n, conv, sizes, digest = None, 0, 0, None, None
    names = ["ids", "sizes", "n", "conv", "ends"]

    def close() -> dict:
        return dict(zip(names, (now, sizes, n, conv, digest.hexdigest())))

    for b in batches:
        out = []
        for ids, size, m, c, piece in zip(*(b.column(x).to_pylist() for x in ("ids", "sizes", "n", "conv", "piece"))):
            if ids != now:
                if digest is not None:
                    out.append(close())
                now, sizes, n, conv, digest = ids, size, m, c, hashlib.sha256(piece.encode())
            else:
                n, conv = n + m, min(conv, c)
                digest.update(b"," + piece.encode())
        if out:
            yield _class_batch(out, names)
    if digest is not None:
        yield _class_batch([close()], names)


def _class_batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)


def classes(convs: DataFrame) -> DataFrame:
    """conv_id, turns to one row for each distinct array of turns."""
    part = lambda name: F.transform("turns", lambda t: t[name])
    rows = convs.select(part("id").alias("ids"), part("size").alias("sizes"), "conv_id", F.floor(F.col("conv_id") / CHUNK).alias("chunk"))
    pieces = rows.groupBy("ids", "sizes", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("piece"))
    return pieces.repartition("ids").sortWithinPartitions("ids", "chunk").mapInArrow(_digests, _CLASS)


def quicksort(ids: list[tuple], order: list[int], depth: int, enter, leave) -> None:
    """Multikey quicksort of order (indices into ids, which are distinct and alike up to depth) with a stack of parts.

    enter(parent, depth, members) is called for each prefix of depth turns that the recursion reaches, with what enter
    gave for the prefix before (None at the start), and leave(node, member) for the member that ends there.
    """
    stack = [(order, depth, None)]
    while stack:
        part, d, parent = stack.pop()
        if len(part) == 1 or not part:  # one array is a chain
            for i in part:
                for e in range(d, len(ids[i])):
                    parent = enter(parent, e + 1, part)
                leave(parent, i)
            continue
        pivot = ids[part[len(part) // 2]][d]
        less, more, same = [i for i in part if ids[i][d] < pivot], [i for i in part if ids[i][d] > pivot], [i for i in part if ids[i][d] == pivot]
        stack += [(p, d, parent) for p in (more, less) if p]
        node = enter(parent, d + 1, same)
        rest = [i for i in same if len(ids[i]) > d + 1]
        if len(rest) < len(same):
            leave(node, next(i for i in same if len(ids[i]) == d + 1))
        if rest:
            stack.append((rest, d + 1, node))


def _bucket_nodes(rows: list[tuple]) -> dict[str, list]:
    """rows: ids, sizes, n, conv, ends, depth, parent of one bucket. Nodes below the parent, sums over subtrees included."""
    depth, top = rows[0][5], rows[0][6]
    cols: dict[str, list] = {c: [] for c in ("conv", "depth", "parent", "n", "children", "leaves", "saved", "ends", "top")}
    above: list[int | None] = []

    def enter(parent, d, members):
        n, conv = sum(rows[i][2] for i in members), min(rows[i][3] for i in members)
        cost = (n - 1) * rows[members[0]][1][d - 1]
        for c, v in zip(cols, (conv, d, top if parent is None else cols["conv"][parent], n, 0, 0, cost, NO_ENDS, parent is None)):
            cols[c].append(v)
        above.append(parent)
        return len(above) - 1

    def leave(node, i):
        cols["ends"][node] = rows[i][4]

    quicksort([r[0] for r in rows], list(range(len(rows))), depth, enter, leave)
    for i in range(len(above) - 1, -1, -1):  # children come after their parents
        if not cols["children"][i]:
            cols["leaves"][i] = 1
        if above[i] is not None:
            cols["children"][above[i]] += 1
            cols["leaves"][above[i]] += cols["leaves"][i]
            cols["saved"][above[i]] += cols["saved"][i]
    return cols


def _local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes sorted by bucket to the nodes of their subtrees."""
    kinds = (pa.int64(),) * 7 + (pa.string(), pa.bool_())
    held: list[tuple] = []
    key = None

    def made(rows):
        cols = _bucket_nodes(rows)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds)], names=list(cols))

    out: list[pa.RecordBatch] = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "n", "conv", "ends", "depth", "parent"))):
            new = (row[5], row[6], row[0][row[5]])
            if new != key and held:
                out.append(made(held))
                held = []
                if sum(map(len, out)) >= 10_000:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out = []
            key = new
            held.append(row)
    if held:
        out.append(made(held))
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def _large(active: DataFrame) -> DataFrame:
    """The buckets of a round that no task should hold: key, members, and the arrays of the prefix that all share."""
    stats = active.groupBy("depth", "parent", "digit").agg(
        F.count(F.lit(1)).alias("classes"), F.sum(F.size("ids")).alias("turns"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
        F.min(F.struct("ids", "sizes")).alias("least"), F.max("ids").alias("most"),
    ).where((F.col("classes") > 1) & ((F.col("classes") > LOCAL_CLASSES) | (F.col("turns") > LOCAL_TURNS)))
    differs = F.array_position(F.zip_with("least.ids", "most", lambda a, b: a.eqNullSafe(b)), F.lit(False)) - 1
    # the arrays differ, so there is a first place where they do
    return stats.withColumn("to", differs).select("depth", "parent", "digit", "n", "conv", "to", F.slice("least.sizes", 1, F.col("to").cast("int")).alias("sizes"))


def _sums(tops: DataFrame) -> DataFrame:
    """What the nodes under each parent add up to; tops: parent, depth of the children, leaves, saved."""
    return tops.groupBy("parent", (F.col("depth") - 1).alias("at")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def trie(rows: DataFrame) -> DataFrame:
    """rows: ids, sizes, n, conv, ends (one for each distinct array). One row a node, the root included."""
    rows = saved(rows)
    root = rows.agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min(F.when(F.size("ids") == 0, F.col("ends"))).alias("ends"))
    top = root.first()
    if top.n is None:
        return rows.sparkSession.createDataFrame([], _NODE).drop("top")
    whole = lambda x: F.lit(x).cast("long")
    root = root.select(whole(-1).alias("depth"), whole(None).alias("parent"), "n", "conv", whole(0).alias("to"), F.array().cast("array<bigint>").alias("sizes"), "ends")
    digit = lambda: F.element_at("ids", F.col("depth").cast("int") + 1)
    active = rows.where(F.size("ids") > 0).withColumns({"depth": whole(0), "parent": whole(top.conv)}).withColumn("digit", digit())
    key, levels, local = ["depth", "parent", "digit"], [root], []
    while True:
        big = saved(_large(active))
        found = big.count()
        if not found:
            local.append(active)
            break
        names = big.select(*key, F.col("to").alias("_to"), F.col("conv").alias("_conv"))
        met = active.join(F.broadcast(names) if found <= BROADCAST else names, key, "left")
        local.append(met.where("_to IS NULL").drop("_to", "_conv"))
        on = saved(met.where("_to IS NOT NULL").select("ids", "sizes", "n", "conv", "ends", F.col("_to").alias("depth"), F.col("_conv").alias("parent")))
        ended = on.where(F.size("ids") == F.col("depth")).select(F.col("depth").alias("to"), F.col("parent").alias("conv"), "ends")
        levels.append(saved(big.drop("digit").join(ended, ["to", "conv"], "left")))
        active = on.where(F.size("ids") > F.col("depth")).withColumn("digit", digit())
    parts = local[0]
    for x in local[1:]:
        parts = parts.unionByName(x)
    under = saved(parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(_local_nodes, _NODE))
    sums = _sums(under.where("top"))
    out, above = under.drop("top"), None
    for level in reversed(levels):
        below = sums if above is None else sums.unionByName(_sums(above)).groupBy("parent", "at").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
        met = level.join(below.withColumnsRenamed({"parent": "conv", "at": "to", "saved": "_saved"}), ["conv", "to"], "left")
        met = saved(met.withColumns({c: F.coalesce(c, whole(v)) for c, v in (("children", 0), ("leaves", 1), ("_saved", 0))}))
        chain = met.select("*", F.explode(F.sequence(F.col("depth") + 1, F.col("to"))).alias("d"))
        cost = (F.col("n") - 1) * F.aggregate(F.slice("sizes", F.greatest(F.col("d"), F.lit(1)).cast("int"), F.size("sizes")), F.lit(0).cast("long"), lambda a, x: a + x)
        last = F.col("d") == F.col("to")
        nodes = chain.select(
            "conv", F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth") + 1, F.col("parent")).otherwise(F.col("conv")).alias("parent"), "n",
            F.when(last, F.col("children")).otherwise(1).cast("long").alias("children"), "leaves", (F.col("_saved") + cost).alias("saved"),
            F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends"), (F.col("d") == F.col("depth") + 1).alias("top"),
        )
        above = nodes.where("top")
        out = out.unionByName(nodes.drop("top"))
    return out


def prefix_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """conversations: conv_id, turn, role, text. One row for each node of the trie of rebuilt conversations.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Rows with a null conv_id are of no conversation and take no part; a null role or text is
    empty. Turns of one number go by role, then by the hash of the text; repeated rows are turns of their own. A
    conversation is held as one array (16 bytes a turn); its texts never leave their task. Empty table: no rows.
    """
    small_batches(conversations.sparkSession)
    nodes = trie(classes(with_heads(encoded(conversations), every, heads)))
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
