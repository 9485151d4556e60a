"""Approximate nearest neighbours: stable projections to few dimensions, kd-trees over them, a chi-square stopping test.

Largest inner products become nearest vectors by one more coordinate, sqrt(M^2 - |x|^2) for a candidate and 0 for a
query, M the largest norm. Gaussian projections to ``DIMENSIONS`` are 2-stable: the squared projected distance of two
vectors over their squared distance follows a chi-square law with that many degrees of freedom. So, with the k-th
nearest vector found so far at distance d, one that is nearer has a projected distance over d * sqrt(q) only with
probability 1 - ``CONFIDENCE``, q that quantile of the law, and the search by growing projected distance stops there.

The top of the kd-tree cuts the projected space into cells, which are the pieces of work; each cell continues it. A
query first searches its own cell, which bounds its radius, then the other cells that meet the radius.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsheaf.plans.files import materialise

DIMENSIONS = 8
CONFIDENCE = 0.97
# Vectors in a cell, about, and in a leaf of a cell's tree.
CELL = 4096
LEAF = 64
# Queries that a task searches a cell for at a time, and cells besides its own that a query searches before the others.
ASKING = 1024
NEAR = 4
# Projected vectors that the cuts of the top are fitted on.
SAMPLE = 50_000
SEED = 7


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


class Cells:
    """The top of the kd-tree: cuts at medians of a sample, in turn along the widest side, to ``count`` cells.

    Nodes are numbered as they are made; a node without a cut is a cell.
    """

    def __init__(self, sample: np.ndarray, count: int):
        sides = sample.shape[1]
        rows = []  # axis, cut, left, right of each node; the axis of a cell is -1
        boxes = [(np.full(sides, -np.inf), np.full(sides, np.inf))]
        stack = [(0, sample, count)]
        rows.append([-1, 0.0, 0, 0])
        while stack:
            node, own, count = stack.pop()
            spread = np.ptp(own, axis=0) if len(own) > 1 else np.zeros(sides)
            if count < 2 or spread.max() == 0:
                continue
            axis = int(np.argmax(spread))
            values = np.sort(own[:, axis])
            cut = values[int(len(values) * (count // 2) / count)]
            if cut == values[0]:
                cut = values[np.searchsorted(values, cut, side="right")]
            low, high = boxes[node]
            below, above = high.copy(), low.copy()
            below[axis] = above[axis] = cut
            under = own[:, axis] < cut
            rows[node] = [axis, cut, len(rows), len(rows) + 1]
            stack += [(len(rows), own[under], count // 2), (len(rows) + 1, own[~under], count - count // 2)]
            rows += [[-1, 0.0, 0, 0], [-1, 0.0, 0, 0]]
            boxes += [(low, below), (above, high)]
        axis, cut, left, right = zip(*rows)
        self.axis, self.cut, self.left, self.right = np.array(axis), np.array(cut), np.array(left), np.array(right)
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(self.axis[at] >= 0)).size:
            node = at[inner]
            under = points[inner, self.axis[node]] < self.cut[node]
            at[inner] = np.where(under, self.left[node], self.right[node])
        return at

    def within(self, points: np.ndarray, radii: np.ndarray) -> list[np.ndarray]:
        """The cells that the ball around each point meets, the nearest first: one way down the tree for all points."""
        point, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        met = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        while len(point):
            gap = np.maximum(np.maximum(self.low[node] - points[point], points[point] - self.high[node]), 0)
            squared = (gap * gap).sum(axis=1)
            inside = squared <= radii[point] ** 2
            point, node, squared = point[inside], node[inside], squared[inside]
            cell = self.axis[node] < 0
            met.append((point[cell], node[cell], squared[cell]))
            point, node = point[~cell], node[~cell]
            point, node = np.concatenate([point, point]), np.concatenate([self.left[node], self.right[node]])
        point, node, squared = (np.concatenate(x) for x in zip(*met))
        order = np.lexsort((node, squared, point))
        return np.split(node[order], np.searchsorted(point[order], np.arange(1, len(points))))


class Tree:
    """A cell's vectors in leaves of a kd-tree over their projections."""

    def __init__(self, projected: np.ndarray):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(projected))]
        while stack:
            own = stack.pop()
            spread = np.ptp(projected[own], axis=0) if len(own) else np.zeros(1)
            if len(own) <= LEAF or spread.max() == 0:
                if len(own):
                    self.leaves.append(own)
                continue
            half = len(own) // 2
            order = np.argpartition(projected[own, int(np.argmax(spread))], half)
            stack += [own[order[:half]], own[order[half:]]]
        self.low = np.array([projected[x].min(axis=0) for x in self.leaves])
        self.high = np.array([projected[x].max(axis=0) for x in self.leaves])

    def squared(self, points: np.ndarray) -> np.ndarray:
        """The squared distance of each point from each leaf."""
        gap = np.maximum(np.maximum(self.low - points[:, None], points[:, None] - self.high), 0)
        return (gap * gap).sum(axis=2)


def _search(members: pd.DataFrame, queries: pd.DataFrame, k: int, quantile: float, norm: float) -> pd.DataFrame:
    """The best ``k`` members (``vec``, ``score``) found for each query (``query``, its ``bound`` so far).

    Leaves come by projected distance, those nearest to any of the queries first. Each is verified for all queries at once
    whose stopping test doesn't hold yet.
    """
    if not len(members) or not len(queries):
        return pd.DataFrame({"query": [], "vec": [], "score": []}).astype({"query": "int64", "vec": "int64", "score": "float64"})
    vectors, asked = (np.stack(x["embedding"]).astype(np.float64) for x in (members, queries))
    tree, points = Tree(np.stack(members["projected"])), np.stack(queries["projected"])
    length, bound = (asked * asked).sum(axis=1) + norm * norm, queries["bound"].to_numpy()
    squared = tree.squared(points)
    best, found = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), np.int64)
    kth = bound.copy()
    for leaf in np.argsort(squared.min(axis=0), kind="stable"):
        # squared distance of the k-th nearest so far, from its inner product
        open_ = np.flatnonzero(squared[:, leaf] <= quantile * np.maximum(length - 2 * kth, 0))
        if len(open_):
            own = tree.leaves[leaf]
            scores = np.concatenate([best[open_], asked[open_] @ vectors[own].T], axis=1)
            at = np.concatenate([found[open_], np.broadcast_to(own, (len(open_), len(own)))], axis=1)
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            best[open_], found[open_] = np.take_along_axis(scores, top, 1), np.take_along_axis(at, top, 1)
            kth[open_] = np.maximum(bound[open_], best[open_].min(axis=1))
    query, place = np.nonzero(best > -np.inf)
    at = found[query, place]
    scores = np.concatenate([(vectors[a] * asked[q]).sum(axis=1) for a, q in zip(_cut(at), _cut(query))] or [np.zeros(0)])
    return pd.DataFrame({"query": queries["query"].to_numpy()[query], "vec": members["vec"].to_numpy()[at], "score": scores})


def _cut(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[i : i + CELL] for i in range(0, len(rows), CELL)]


def _met(members: DataFrame, sizes: DataFrame, asked: DataFrame, search) -> DataFrame:
    """``query, vec, score`` that ``search`` finds in the cells (``cell``) of ``asked``.

    A cell's vectors are cut into parts and its queries into blocks of bounded size, and each part meets each block.
    """
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("blocks"))
    cuts = F.broadcast(materialise(sizes.join(blocks, "cell"), "nearest-cuts"))  # a row per cell; cells are at most SAMPLE
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    own = members.join(cuts, "cell").withColumn("part", place("vec", "parts")).withColumn("block", every("blocks")).drop("parts", "blocks")
    other = asked.join(cuts, "cell").withColumn("block", place("query", "blocks")).withColumn("part", every("parts")).drop("parts", "blocks")
    unit = ["cell", "part", "block"]
    met = own.groupBy(*unit).cogroup(other.groupBy(*unit)).applyInPandas(search, "query long, vec long, score double")
    return materialise(met, "nearest-met")


def _normal(rows: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((rows, DIMENSIONS))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    confidence: float = CONFIDENCE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner products for each row of ``queries``, itself left out by its id.

    Returns ``query_id`` (long), ``rank`` (int, from 1), ``vec_id`` (long), ``score`` (double: the inner product of the
    original vectors), ties to the smaller id; fewer than ``k`` only where there are no more. Null and zero
    vectors, those with a null or non-finite component and rows with a null id take no part. Ids must be unique, and all vectors
    of one length, else it raises. Other columns are not looked at. Without vectors or queries there are no rows.

    Equal vectors are one entry of the index, with the ``k + 1`` smallest ids of its group (no query returns
    more), and equal queries are searched once. The index holds every other vector; only its top cuts are fitted
    on a sample of about ``SAMPLE``. Each vector that ``confidence`` allows to be missed is missed with
    the chance 1 - ``confidence`` at most.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        numbers = F.col(vector_col).cast("array<double>")
        good = F.forall(numbers, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
        rows = df.select(F.col(id_col).cast("long").alias("id"), numbers.alias("embedding")).where(good & F.col("id").isNotNull())
        # -0.0 and 0.0 are one
        rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
        return rows.where(F.exists("embedding", lambda x: x != 0.0))

    kept, asked = clean(vectors), clean(queries)
    by_id = Window.partitionBy("embedding").orderBy("id")
    entries = kept.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    entries = entries.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialise(entries.select(F.element_at("ids", 1).alias("vec"), "ids", "embedding"), "nearest-entries")
    asked = materialise(asked, "nearest-asked")
    searched = materialise(asked.groupBy("embedding").agg(F.min("id").alias("query")), "nearest-queries")

    squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    sums = entries.agg(F.count("*").alias("n"), F.max(squared).alias("m"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sums["n"]:
        return spark.createDataFrame([], schema)
    if sums["least"] != sums["most"] or not searched.where(F.size("embedding") != sums["most"]).isEmpty():
        raise ValueError("vectors of different lengths")
    norm, length = math.sqrt(sums["m"]), sums["most"]
    quantile = chi_square_quantile(confidence, DIMENSIONS)

    def project(column: str, is_query: bool):
        @F.pandas_udf("array<double>")
        def run(values: pd.Series) -> pd.Series:
            x = np.stack(values.to_list()) if len(values) else np.zeros((0, length))
            basis = _normal(length + 1, SEED)
            last = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
            return pd.Series(list(x @ basis[:-1] + last[:, None] * basis[-1]))

        return run(column)

    entries = entries.withColumn("projected", project("embedding", False))
    searched = materialise(searched.withColumn("projected", project("embedding", True)), "nearest-projected")
    share = min(1.0, SAMPLE / sums["n"])
    sample = entries.select("projected").sample(fraction=share, seed=SEED).toPandas()["projected"]
    sample = np.stack(sample.to_list()) if len(sample) else np.zeros((0, DIMENSIONS))
    cells = Cells(sample, max(1, round(sums["n"] / CELL)))
    shared = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("int")
    def cell_of(values: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(np.stack(values.to_list())) if len(values) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def cells_within(values: pd.Series, radius: pd.Series) -> pd.Series:
        points = np.stack(values.to_list()) if len(values) else np.zeros((0, DIMENSIONS))
        return pd.Series([c.tolist() for c in shared.value.within(points, radius.to_numpy())][: len(values)])

    members = materialise(entries.withColumn("cell", cell_of("projected")).select("cell", "vec", "embedding", "projected"), "nearest-cells")
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("parts"))
    sizes = materialise(sizes, "nearest-parts")
    home = searched.withColumn("cell", cell_of("projected"))

    def search(_, own, other):
        # k + 1, as the query's own vector may be one of them
        return _search(own, other, k + 1, quantile, norm)

    never = F.lit(float("-inf"))
    found = _met(members, sizes, home.withColumn("bound", never), search)
    squared_q = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    # first the cells nearest to a query, then all that the radius they leave still meets
    for start, end in ((0, NEAR), (NEAR, None)):
        # the bound may count only as many entries as k + 1 inner products need
        kth = found.groupBy("query").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("kth"))
        rest = home.join(kth, "query", "left").withColumn("bound", F.coalesce("kth", never))
        reach = F.sqrt(F.lit(quantile) * F.greatest(squared_q + norm * norm - 2 * F.col("bound"), F.lit(0.0)))
        # nearest first, so a smaller radius leaves the first of them as they are
        others = F.array_remove(cells_within("projected", reach), F.col("cell"))
        others = F.slice(others, start + 1, F.lit(end - start) if end else F.greatest(F.size(others) - start, F.lit(0)))
        rest = rest.select("query", "embedding", "projected", "bound", F.explode(others).alias("cell"))
        found = found.unionByName(_met(members, sizes, materialise(rest, "nearest-rest"), search))
    found = materialise(found, "nearest-found")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    # back to rows: every id of an entry, for every query with that vector
    hits = found.join(entries.select("vec", "ids"), "vec").select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k + 1)
    answers = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("hits"))
    same = asked.join(searched.select("embedding", "query"), "embedding").select(F.col("id").alias("query_id"), "query")
    own = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    rows = same.join(answers, "query").select("query_id", F.posexplode(own).alias("at", "hit"))
    return rows.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
