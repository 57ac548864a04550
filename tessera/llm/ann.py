"""Nearest neighbours by inner product over low-dimensional stable projections, indexed by a kd-tree.

Largest inner product is smallest distance once each vector x gets one more coordinate sqrt(M^2 - |x|^2), with
M the largest norm, and a query gets 0 there: |q - x|^2 = |q|^2 + M^2 - 2 q.x. The order doesn't hang on the query's
length, so queries are stretched to length M, where near and far vectors differ most. Gaussian (2-stable) projections
to DIMS dimensions keep distances up to a chi-square factor: projected^2 / true^2 has DIMS degrees of freedom.

The upper levels of the kd-tree are fitted on a bounded sample of projected vectors, and every vector is put
into its cell. Cells that turn out too large are split on by trees of their own, each fitted in a task on a bounded
sample of the cell, so cells stay near CELL vectors however many there are. A query first searches its own cell, leaf
by leaf in order of projected distance, verifying each leaf's vectors by true inner products. It stops once the next
leaf's projected distance passes the test: were there a nearer vector than the worst kept one beyond it, its
projection would be that far with probability below 1 - CONFIDENCE. The same test picks the other cells that the
query must still visit, at CELL_CONFIDENCE, since a box's distance is well below that of most vectors in it: first
the FIRST nearest boxes, which lower the bound to about its final value, then, with that bound, all others that pass.

Equal vectors are one class, with its smallest ids: a class has at most K + 1 that can matter. Classes are ranked by
score and then by their smallest id before any is cut, so that ties go to the smaller ids.
"""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import saved

K = 20
DIMS = 8
CONFIDENCE = 0.97
#: Of the test that whole cells must pass.
CELL_CONFIDENCE = 0.6
#: Cells that a query visits after its own and before all others.
FIRST = 16
#: Most vectors that the upper tree is fitted on.
SAMPLE = 20_000
CELL, LEAF = 2048, 256
#: Vectors that a tree is fitted on for each of its cells.
PER_CELL = 16
#: Most queries that are searched in one cell at once.
QUERY_BLOCK = 4096
#: Room for rounding between a matrix product and the exact sum, as a share of the two norms' product.
_ROUNDING = 1e-12
#: Most pairs of query and cell that a worker tests at once.
_PAIRS = 4_000_000


def chi_square_quantile(p: float, m: int) -> float:
    """For even m, by bisection of the closed form of the distribution."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part; of rows with one vec_id, the least vector."""
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column, width: int) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def _projection(width: int, dims: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((width + 1, dims))


def _projected(x: np.ndarray, norm: float | None, proj: np.ndarray) -> np.ndarray:
    """norm: the largest norm for indexed vectors, None for queries (whose last coordinate is 0)."""
    out = x @ proj[:-1]
    if norm is not None:
        out += np.sqrt(np.maximum(0.0, norm**2 - (x**2).sum(axis=1)))[:, None] * proj[-1]
    return out


def _stretch(q: np.ndarray, norm: float) -> np.ndarray:
    """What each query is multiplied with, to be as long as the longest vector."""
    length = np.sqrt((q**2).sum(axis=1))
    return np.divide(norm, length, out=np.ones(len(q)), where=length > 0)


def _far(q: np.ndarray, stretch: np.ndarray, norm: float, score: np.ndarray) -> np.ndarray:
    """Squared distance from stretched queries of the vectors with these inner products with the queries themselves."""
    return np.maximum(0.0, (q**2).sum(axis=1) * stretch**2 + norm**2 - 2 * stretch * score)


class Tree:
    """Median splits of the widest dimension; leaf i of the tree is cell i, a box of the projected space."""

    def __init__(self, points: np.ndarray, depth: int, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        dims = points.shape[1]
        self.depth = depth
        self.dim, self.cut = np.zeros(2**depth, np.int64), np.zeros(2**depth)
        self.lo, self.hi = np.full((2 ** (depth + 1), dims), -np.inf), np.full((2 ** (depth + 1), dims), np.inf)
        if lo is not None:
            self.lo[1], self.hi[1] = lo, hi
        held = {1: points}
        for node in range(1, 2**depth):
            mine = held.pop(node)
            d = int(np.argmax(mine.max(axis=0) - mine.min(axis=0))) if len(mine) else 0
            cut = float(np.median(mine[:, d])) if len(mine) else 0.0
            self.dim[node], self.cut[node] = d, cut
            for child, keep in ((2 * node, mine[:, d] < cut), (2 * node + 1, mine[:, d] >= cut)):
                self.lo[child], self.hi[child], held[child] = self.lo[node], self.hi[node], mine[keep]
            self.hi[2 * node, d] = cut
            self.lo[2 * node + 1, d] = cut

    @property
    def cells(self) -> int:
        return 2**self.depth

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] >= self.cut[node])
        return node - 2**self.depth

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared distance from each point to each cell's box."""
        out = np.zeros((len(points), self.cells))
        for d in range(points.shape[1]):
            p = points[:, d, None]
            out += np.maximum(0.0, np.maximum(self.lo[self.cells :, d] - p, p - self.hi[self.cells :, d])) ** 2
        return out

    def near(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which points reach which cells' boxes (squared distance at most `reach`)."""
        return self.near_with_gaps(points, reach)[:2]

    def near_with_gaps(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near(), and those squared distances: down the tree, far branches left out."""
        who, node = np.arange(len(points)), np.ones(len(points), np.int64)
        for level in range(self.depth + 1):
            gap = (np.maximum(0.0, np.maximum(self.lo[node] - points[who], points[who] - self.hi[node])) ** 2).sum(axis=1)
            keep = gap <= reach[who]
            who, node, gap = who[keep], node[keep], gap[keep]
            if level < self.depth:
                who, node = np.repeat(who, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
        return who, node - self.cells, gap


class Index:
    """The upper tree, and trees of their own for its large cells; cells are numbered one tree after the other."""

    def __init__(self, upper: Tree, lower: dict[int, Tree]):
        self.upper, self.lower = upper, lower
        self.first, at = {}, upper.cells
        for c in sorted(lower):
            self.first[c] = at
            at += lower[c].cells

    def cell(self, points: np.ndarray) -> np.ndarray:
        cell = self.upper.cell(points)
        for c in np.unique(cell):
            if c in self.lower:
                mine = np.flatnonzero(cell == c)
                cell[mine] = self.first[c] + self.lower[c].cell(points[mine])
        return cell

    @property
    def cells(self) -> int:
        """Cells that hold vectors."""
        return self.upper.cells + sum(tree.cells - 1 for tree in self.lower.values())

    def near(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.near_with_gaps(points, reach)[:2]

    def near_with_gaps(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, cell, gap = self.upper.near_with_gaps(points, reach)
        out = [(who, cell, gap)]
        for c in np.unique(cell):
            if c in self.lower:
                mine = who[cell == c]
                i, inner, inner_gap = self.lower[c].near_with_gaps(points[mine], reach[mine])
                out.append((mine[i], self.first[c] + inner, inner_gap))
        who, cell, gap = (np.concatenate(x) for x in zip(*out))
        keep = ~np.isin(cell, list(self.lower))
        return who[keep], cell[keep], gap[keep]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, each summed from the first component to the last."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def _search(q: np.ndarray, proj: np.ndarray, bound: np.ndarray, x: np.ndarray, xp: np.ndarray, ids: np.ndarray, norm: float, tau: float, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Best inner products (-inf where none) and rows of x for each query, ties by ids; bound: one it has from elsewhere."""
    best, at = np.full((len(q), keep), -np.inf), np.full((len(q), keep), -1, np.int64)
    if not len(x) or not len(q):
        return best, at
    depth = max(0, math.ceil(math.log2(len(x) / LEAF))) if len(x) > LEAF else 0
    tree = Tree(xp, depth)
    leaf = tree.cell(xp)
    rows = np.argsort(leaf, kind="stable")
    cuts = np.searchsorted(leaf[rows], np.arange(2**depth + 1))
    stretch = _stretch(q, norm)
    gaps = tree.gaps(_projected(q * stretch[:, None], None, proj))
    order = np.argsort(gaps, axis=1)
    room = np.sqrt((q**2).sum(axis=1)) * norm * _ROUNDING * q.shape[1]
    live = np.arange(len(q))
    for rank in range(2**depth):
        leaves = order[live, rank]
        worst = np.maximum(best[live, -1], bound[live])
        go = gaps[live, leaves] <= tau * _far(q[live], stretch[live], norm, worst)  # -inf: nothing kept yet, goes on
        live, leaves = live[go], leaves[go]
        if not len(live):
            break
        by = np.argsort(leaves, kind="stable")
        steps = np.flatnonzero(np.diff(leaves[by], prepend=-1))
        for i, j in zip(steps, np.append(steps[1:], len(by))):
            who, mine = live[by[i:j]], rows[cuts[leaves[by[i]]] : cuts[leaves[by[i]] + 1]]
            if not len(mine):
                continue
            about = q[who] @ x[mine].T
            least = np.maximum(best[who, -1], bound[who])
            if len(mine) > keep:
                least = np.maximum(least, -np.partition(-about, keep - 1, axis=1)[:, keep - 1])
            # all that may be among the best, ties of the last included, are summed exactly and ranked by score, then id
            a, b = np.nonzero(about >= (least - room[who])[:, None])
            if not len(a):
                continue
            score, row = _exact(q[who[a]], x[mine[b]]), mine[b]
            had, slot = np.nonzero(at[who] >= 0)
            a, score, row = np.concatenate((had, a)), np.concatenate((best[who[had], slot], score)), np.concatenate((at[who[had], slot], row))
            by_rank = np.lexsort((ids[row], -score, a))
            a, score, row = a[by_rank], score[by_rank], row[by_rank]
            place = np.arange(len(a)) - np.searchsorted(a, a, "left")
            top = place < keep
            best[who[a[top]], place[top]], at[who[a[top]], place[top]] = score[top], row[top]
    return best, at


_FOUND = "query_id bigint, vec_id bigint, score double"


def _in_cell(width: int, norm: float, dims: int, tau: float, k: int):
    proj = _projection(width, dims)

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        q, x = _matrix(queries.column("query"), width), _matrix(points.column("embedding"), width)
        own = queries.column("query_id").to_numpy()
        bound = queries.column("bound").to_numpy(zero_copy_only=False)
        members = points.column("ids").to_pylist()
        ids = np.array([m[0] for m in members], np.int64)
        # of classes in order of score and smallest id, the first k + 1 hold the k nearest, the query itself aside
        best, at = _search(q, proj, bound, x, _projected(x, norm, proj), ids, norm, tau, k + 1)
        out: tuple[list, ...] = ([], [], [])
        for i in range(len(q)):
            pairs = sorted(((-s, v) for s, r in zip(best[i].tolist(), at[i]) if r >= 0 for v in members[r] if v != own[i]))[:k]
            for s, v in pairs or [(math.nan, None)]:
                for c, value in zip(out, (own[i], v, -s)):
                    c.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _lower_trees(placed: DataFrame, counts: dict[int, int], upper: Tree, width: int, norm: float, proj: np.ndarray, cell_size: int) -> dict[int, Tree]:
    """A tree for each cell that holds more than twice its size, fitted in a task on PER_CELL vectors a new cell."""
    depths = {c: round(math.log2(n / cell_size)) for c, n in counts.items() if n > 2 * cell_size}
    if not depths:
        return {}
    spark = placed.sparkSession
    share = spark.createDataFrame([(c, min(1.0, 1.25 * PER_CELL * 2**d / counts[c])) for c, d in depths.items()], "cell bigint, share double")  # a row a large cell of the upper tree
    u = F.pmod(F.xxhash64(F.element_at("ids", 1), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    picked = placed.join(F.broadcast(share), "cell").where(u < F.col("share")).select("cell", "embedding")

    def fitted(points: pa.Table) -> pa.Table:
        c = points.column("cell")[0].as_py()
        x = _projected(_matrix(points.column("embedding"), width), norm, proj)
        tree = Tree(x, depths[c], upper.lo[upper.cells + c], upper.hi[upper.cells + c])
        return pa.table([pa.array([c], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary())], names=["cell", "tree"])

    return {r["cell"]: pickle.loads(r["tree"]) for r in picked.groupBy("cell").applyInArrow(fitted, "cell bigint, tree binary").collect()}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, sample: int = SAMPLE, cell_size: int = CELL, cell_confidence: float = CELL_CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (all, if fewer), ties to smaller vec_id.

    vectors: vec_id, embedding; queries: the same columns, and every row of vectors but those with the query's
    own vec_id is a candidate. Null ids, and vectors that are null, zero or hold null or non-finite components,
    take no part; nor do vectors of another length than most have. Rows that share a vec_id count once. Other columns
    are not read. Without usable vectors or queries there are no rows.
    The index takes some 150 bytes a cell in the driver and in each worker: 80 MB for a thousand million vectors.
    """
    return nearest_and_visits(vectors, queries, k, dims, confidence, sample, cell_size, cell_confidence)[0]


def nearest_and_visits(vectors: DataFrame, queries: DataFrame, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, sample: int = SAMPLE, cell_size: int = CELL, cell_confidence: float = CELL_CONFIDENCE) -> tuple[DataFrame, DataFrame, int]:
    """What nearest() returns; query_id, cell of each visit; and how many cells there are."""
    spark = vectors.sparkSession
    ship(spark)
    base, asked = usable(vectors), usable(queries)
    common = base.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if common is None:
        return nothing, spark.createDataFrame([], "query_id bigint, cell bigint"), 0
    width = common["n"]
    # equal vectors are one class; of its ids only the smallest k + 1 can be among a query's k nearest
    by = Window.partitionBy("embedding").orderBy("vec_id")
    few = base.where(F.size("embedding") == width).withColumn("_at", F.row_number().over(by)).where(F.col("_at") <= k + 1)
    classes = saved(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    n, norm2 = classes.agg(F.count(F.lit(1)), F.max(square)).first()
    norm = math.sqrt(norm2) * (1 + 1e-12)
    proj, tau, cell_tau = _projection(width, dims), chi_square_quantile(confidence, dims), chi_square_quantile(cell_confidence, dims)
    fitted = classes.select("embedding").orderBy(F.xxhash64(F.element_at("ids", 1)), F.element_at("ids", 1)).limit(sample).toArrow()
    points = _projected(_matrix(fitted.column("embedding"), width), norm, proj)
    depth = max(0, min(round(math.log2(max(1, n / cell_size))), int(math.log2(max(1, len(points) / PER_CELL)))))
    upper = Tree(points, depth)
    kind = vectors.schema["embedding"].dataType.simpleString()

    def placing(tree):
        def put(batches):
            for batch in batches:
                cell = tree.value.cell(_projected(_matrix(batch.column("embedding"), width), norm, proj))
                yield pa.RecordBatch.from_arrays([batch.column("embedding"), batch.column("ids"), pa.array(cell)], names=["embedding", "ids", "cell"])

        return classes.mapInArrow(put, f"embedding {kind}, ids array<bigint>, cell bigint")

    placed = saved(placing(spark.sparkContext.broadcast(upper)))
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell of the upper tree
    lower = _lower_trees(placed, counts, upper, width, norm, proj, cell_size)
    whole = Index(upper, lower)
    index = spark.sparkContext.broadcast(whole)
    if lower:
        placed = saved(placing(index))

    asked = asked.where(F.size("embedding") == width)

    def home(batches):
        for batch in batches:
            q = _matrix(batch.column("embedding"), width)
            cell = index.value.cell(_projected(q * _stretch(q, norm)[:, None], None, proj))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cell), pa.array(np.full(len(q), -np.inf))], names=["query_id", "cell", "bound"])

    def visits(most: int | None):
        """Cells that pass the test and aren't in `seen` (all or, of each query, the `most` nearest)."""

        def run(batches):
            for batch in batches:
                step = max(1, _PAIRS // whole_cells)
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    q = _matrix(part.column("query"), width)
                    bound = part.column("bound").to_numpy(zero_copy_only=False)
                    stretch = _stretch(q, norm)
                    who, cell, gap = index.value.near_with_gaps(_projected(q * stretch[:, None], None, proj), cell_tau * _far(q, stretch, norm, bound))
                    seen = part.column("seen")
                    had = np.repeat(np.arange(len(q)), seen.value_lengths().to_numpy()) * whole_numbers + seen.flatten().to_numpy()
                    new = ~np.isin(who * whole_numbers + cell, had)
                    who, cell, gap = who[new], cell[new], gap[new]
                    if most is not None:
                        order = np.lexsort((cell, gap, who))
                        who, cell = who[order], cell[order]
                        near = np.arange(len(who)) - np.searchsorted(who, who, "left") < most
                        who, cell = who[near], cell[near]
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(who)), pa.array(cell), pa.array(bound[who])], names=["query_id", "cell", "bound"])

        return run

    whole_cells = whole.cells
    whole_numbers = upper.cells + sum(tree.cells for tree in lower.values())
    shape = "query_id bigint, cell bigint, bound double"
    vector_of = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    run = _in_cell(width, norm, dims, tau, k)

    def search(pairs: DataFrame) -> DataFrame:
        """pairs: query_id, cell, bound. A cell that many queries visit gets them, and its vectors, in several blocks."""
        blocks = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
        left = pairs.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        left = left.join(vector_of, "query_id").select("query_id", "query", "cell", "block", "bound")
        right = placed.join(blocks, "cell").select("embedding", "ids", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(run, _FOUND)

    pairs = [saved(asked.select("vec_id", "embedding").mapInArrow(home, shape))]
    found = saved(search(pairs[0]))
    for most in (FIRST, None):
        # at most k rows and one visit for each of the few cells so far
        kth = F.try_element_at(F.sort_array(F.collect_list(F.when(F.col("vec_id").isNotNull(), F.col("score"))), asc=False), F.lit(k))
        bounds = found.groupBy("query_id").agg(F.coalesce(kth, F.lit(float("-inf"))).alias("bound"))
        seen = reduce(DataFrame.union, pairs).groupBy("query_id").agg(F.collect_list("cell").alias("seen"))
        pairs.append(saved(vector_of.join(bounds, "query_id").join(seen, "query_id").mapInArrow(visits(most), shape)))
        found = found.union(search(pairs[-1]))
        if most is not None:
            found = saved(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score"), reduce(DataFrame.union, pairs).select("query_id", "cell"), whole_cells
