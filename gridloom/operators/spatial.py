"""Neighbour joins over points (id, x array): k nearest, radius, existence, spacing, inverse-distance interpolation.

Points of any dimension are compared block against block: both sides are dealt
into blocks of BLOCK rows, a task holds two blocks and returns at most k (or the
hits) for each of its points, and the partial results are merged by key. In low
dimensions a radius join goes through a hash grid instead, an equi-join on the
neighbouring cells, and the k nearest of many points through the cells of a k-d
tree: first in a query's own cell, then in the others within the distance found
there. Distances are squared.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096
#: Blocks of each side that a task is dealt at once: rows are sent as often as there are tasks along the other side.
_SIDE = 8
#: Points of a cell of the k-d tree, and of its sample that give its planes.
CELL, CELL_SAMPLE, SAMPLE = 1024, 32, 200_000
#: Pairs of blocks from which the k nearest in few dimensions go by cells.
_PAIRS = 16
#: Distances that a task holds at once.
_AT_ONCE = 1 << 24
_NEIGHBOURS = "id long, nbr long, d2 double"
#: Dimensions up to which all distances of two blocks are taken by differences.
_FEW = 4


class Block:
    """Squared distances of a block of queries and a block of points, which are sorted by id.

    In few dimensions they are sums of squared differences. In many, products of the centred blocks
    give them up to `error`, for each query, and `exact` gives those picked by differences again.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        if a.shape[1] <= _FEW:
            self.d2, self.error = np.zeros((len(a), len(b))), np.zeros(len(a))
            for k in range(a.shape[1]):
                self.d2 += (a[:, k, None] - b[None, :, k]) ** 2
            return
        middle = b.mean(axis=0)
        p, q = a - middle, b - middle
        n_p, n_q = (p * p).sum(1), (q * q).sum(1)
        self.d2 = n_p[:, None] + n_q[None, :] - 2 * (p @ q.T)
        # What centring rounds off counts too: it is relative to the coordinates as given.
        scale = n_p + n_q.max() + (np.abs(a).max(1) + np.abs(b).max()) * (np.sqrt(n_p) + np.sqrt(n_q.max()))
        self.error = 4 * (a.shape[1] + 8) * np.finfo(float).eps * scale

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The squared distances of pairs, coordinate after coordinate."""
        if self.a.shape[1] <= _FEW:
            return self.d2[i, j]
        out = np.zeros(len(i))
        for k in range(self.a.shape[1]):
            out += (self.a[i, k] - self.b[j, k]) ** 2
        return out

    def below(self, limit: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i, j, d2) that may be within `limit`, by i and j; all that are within it are among them."""
        i, j = np.nonzero(self.d2 <= (limit + self.error)[:, None])
        return i, j, self.exact(i, j)

    def nearest(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of each query, the first ones of equals."""
        take = min(k, self.d2.shape[1])
        i, j, d2 = self.below(np.partition(self.d2, take - 1, axis=1)[:, take - 1] + self.error)
        order = np.lexsort((j, d2, i))
        i, j, d2 = i[order], j[order], d2[order]
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        return i[rank < take], j[rank < take], d2[rank < take]


def _blockwise(queries: DataFrame, points: DataFrame, kernel: Callable[[Block, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], block: int) -> DataFrame:
    """(id, nbr, d2) of what kernel(block, ids, nbrs) picks as (rows, columns, d2) in each pair of blocks.

    Both sides are dealt in squares of blocks, as large as leaves each core its task, up to _SIDE blocks a side; a square's pairs of blocks follow one another.
    """
    rows_q, rows_p = queries.count(), points.count()
    side = max(1, min(_SIDE, int(((-(-rows_q // block)) * (-(-rows_p // block)) / (2 * queries.sparkSession.sparkContext.defaultParallelism)) ** 0.5)))
    n_q = max(1, -(-rows_q // (side * block)))
    n_p = max(1, -(-rows_p // (side * block)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select("id", "x", dealt(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_p - 1))).alias("pb"), F.lit(True).alias("asks"))
    right = points.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), dealt(n_p).alias("pb"), F.lit(False).alias("asks"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, p = rows[rows["asks"]], rows[~rows["asks"]].sort_values("id")
        if q.empty or p.empty:
            return pd.DataFrame({"id": [], "nbr": [], "d2": []}).astype({"id": "int64", "nbr": "int64", "d2": "float64"})
        a, b, ids, nbrs = np.stack(q["x"].to_numpy()), np.stack(p["x"].to_numpy()), q["id"].to_numpy(), p["id"].to_numpy()
        found = []
        for at in range(0, len(a), block):
            for to in range(0, len(b), block):
                own, others = ids[at : at + block], nbrs[to : to + block]
                i, j, d2 = kernel(Block(a[at : at + block], b[to : to + block]), own, others)
                found.append(pd.DataFrame({"id": own[i], "nbr": others[j], "d2": d2}))
        return pd.concat(found)

    return left.unionByName(right.select(left.columns)).groupBy("qb", "pb").applyInPandas(run, _NEIGHBOURS)


class Cells:
    """A k-d tree of half-open cells that cover the space: its planes halve a sample, so any other point has its cell too."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.axis, self.value, self.sons = [], [], []
        rows = [(sample, None)]
        while rows:
            p, father = rows.pop()
            node = len(self.axis)
            if father is not None:
                self.sons[father[0]][father[1]] = node
            axis = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
            cut = len(p) > leaf and np.ptp(p[:, axis]) > 0
            self.axis.append(axis if cut else -1)
            self.sons.append([-1, -1])
            middle = np.partition(p[:, axis], len(p) // 2)[len(p) // 2] if cut else 0.0
            if cut and middle == p[:, axis].min():
                middle = p[p[:, axis] > middle, axis].min()
            self.value.append(float(middle))
            if cut:
                left = p[:, axis] < middle
                rows += [(p[~left], (node, 1)), (p[left], (node, 0))]
        self.axis, self.value, self.sons = np.array(self.axis), np.array(self.value), np.array(self.sons)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(live := live[self.axis[node[live]] >= 0]):
            at = node[live]
            node[live] = self.sons[at, (x[live, self.axis[at]] >= self.value[at]).astype(int)]
        return node

    def within(self, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): all cells that may have a point within each row's squared distance; sums go as those of Block do, so none is missed by rounding."""
        rows, cells, stack = [], [], [(0, np.arange(len(x)), np.zeros_like(x))]
        while stack:
            node, at, off = stack.pop()
            if not len(at):
                continue
            axis = self.axis[node]
            if axis < 0:
                rows.append(at)
                cells.append(np.full(len(at), node))
                continue
            beyond = x[at, axis] - self.value[node]
            far, d2 = off.copy(), np.zeros(len(at))
            far[:, axis] = np.maximum(off[:, axis], np.abs(beyond))
            for k in range(x.shape[1]):
                d2 += far[:, k] ** 2
            for side, own in enumerate((beyond < 0, beyond >= 0)):
                kept = own | (d2 <= limit[at])
                stack.append((self.sons[node, side], at[kept], np.where(own[kept, None], off[kept], far[kept])))
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _vectors(x: pd.Series, dim: int) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, dim))


def _met(queries: DataFrame, points: DataFrame, work: Callable, schema: str, block: int) -> DataFrame:
    """work(queries, points, cell) of each cell: its points, with at most `block` of its queries at a time."""
    asked = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    other = [c for c in queries.columns if c not in ("id", "x", "cell")]
    left = queries.join(asked, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("part"), "id", "x", *other, F.lit(True).alias("asks"))
    right = points.join(asked, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "id", "x", *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in other], F.lit(False).alias("asks"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return work(rows[rows["asks"]], rows[~rows["asks"]].sort_values("id"), int(rows["cell"].iloc[0]))

    return left.unionByName(right).groupBy("cell", "part").applyInPandas(run, schema)


def _knn_by_cells(queries: DataFrame, points: DataFrame, k: int, block: int, n: int, dim: int) -> DataFrame:
    """knn in few dimensions. Of points at one place only the k first can be among the k nearest of any query, so the others are left out."""
    from ..session import cut_lineage

    leaf = max(min(CELL, block), 2 * k)
    every = max(1, leaf // CELL_SAMPLE, n // SAMPLE)
    sample = points.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(*[F.col("x")[i].alias(f"x{i}") for i in range(dim)]).toPandas().to_numpy(float)
    tree = Cells(sample, max(1, leaf // every))

    def placed(df: DataFrame) -> DataFrame:
        def run(frames):
            for f in frames:
                yield f.assign(cell=tree.of(_vectors(f["x"], dim)))

        return df.select("id", "x").mapInPandas(run, "id long, x array<double>, cell long")

    here = cut_lineage(placed(points).withColumn("_n", F.row_number().over(W.partitionBy("x").orderBy("id"))).filter(F.col("_n") <= k).drop("_n"))
    asks = cut_lineage(placed(queries))

    def nearest(q: np.ndarray, p: np.ndarray):
        step = max(1, _AT_ONCE // max(1, len(p)))
        for i in range(0, len(q) if len(p) else 0, step):
            rows, cols, d2 = Block(q[i : i + step], p).nearest(k)
            yield rows + i, cols, d2

    def first(q: pd.DataFrame, p: pd.DataFrame, cell: int) -> pd.DataFrame:
        x, ids, limit = _vectors(q["x"], dim), p["id"].to_numpy(), np.full(len(q), np.inf)
        nbr, d2 = [ids[:0]] * len(q), [np.zeros(0)] * len(q)
        for i, j, d in nearest(x, _vectors(p["x"], dim)):
            each = len(i) // len(np.unique(i))
            for at, a, b in zip(i[::each], ids[j].reshape(-1, each), d.reshape(-1, each), strict=True):
                nbr[at], d2[at] = a, b
                limit[at] = b[-1] if each == k else np.inf
        rows, cells = tree.within(x, limit)
        order = np.argsort(rows, kind="stable")
        rows, cells = rows[order], cells[order]
        rows, cells = rows[cells != cell], cells[cells != cell]
        more = np.split(cells, np.cumsum(np.bincount(rows, minlength=len(q)))[:-1]) if len(q) else []
        return pd.DataFrame({"id": q["id"].to_numpy(), "x": q["x"].to_numpy(), "nbr": nbr, "d2": d2, "limit": limit, "more": more})

    def others(q: pd.DataFrame, p: pd.DataFrame, cell: int) -> pd.DataFrame:
        ids, nbrs, limit = q["id"].to_numpy(), p["id"].to_numpy(), q["limit"].to_numpy(float)
        out = [pd.DataFrame({"id": ids[:0], "nbr": nbrs[:0], "d2": np.zeros(0)}).astype({"id": "int64", "nbr": "int64"})]
        for i, j, d in nearest(_vectors(q["x"], dim), _vectors(p["x"], dim)):
            kept = d <= limit[i]
            out.append(pd.DataFrame({"id": ids[i[kept]], "nbr": nbrs[j[kept]], "d2": d[kept]}))
        return pd.concat(out)

    own = cut_lineage(_met(asks, here, first, "id long, x array<double>, nbr array<long>, d2 array<double>, limit double, more array<long>", block))
    open_ = F.size("more") > 0
    flat = lambda df: df.select("id", F.posexplode(F.arrays_zip("nbr", "d2")).alias("ord", "e")).select("id", "ord", "e.nbr", "e.d2")
    again = _met(own.filter(open_).select("id", "x", "limit", F.explode("more").alias("cell")), here, others, _NEIGHBOURS, block)
    return flat(own.filter(~open_)).unionByName(top_k(flat(own.filter(open_)).drop("ord").unionByName(again), k))


def knn(queries: DataFrame, points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, ord, nbr, d2): the k nearest of `points`, by squared distance, then id; a point is its own neighbour."""
    n = points.count()
    if -(-queries.count() // block) * -(-n // block) > _PAIRS and (dim := points.select(F.size("x")).first()[0]) <= _FEW:
        return _knn_by_cells(queries, points, k, block, n, dim)
    return top_k(_blockwise(queries, points, lambda pair, ids, nbrs: pair.nearest(k), block), k)


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("id").orderBy("d2", "nbr"))
    return pairs.withColumn("ord", rank - 1).filter(F.col("ord") < k).select("id", "ord", "nbr", "d2")


def force_self(neighbours: DataFrame, k: int) -> DataFrame:
    """Neighbour lists that start with the node itself: where it isn't first, it is put there and the last one goes."""
    first = neighbours.filter("ord = 0").select(F.col("id").alias("_id"), (F.col("nbr") == F.col("id")).alias("_own"))
    odd = neighbours.join(first, F.col("id") == F.col("_id")).drop("_id")
    shifted = odd.withColumn("ord", F.when(F.col("_own"), F.col("ord")).otherwise(F.col("ord") + 1)).filter(F.col("ord") < k)
    selves = first.filter(~F.col("_own")).select(F.col("_id").alias("id"), F.lit(0).alias("ord"), F.col("_id").alias("nbr"), F.lit(0.0).alias("d2"))
    return shifted.select("id", "ord", "nbr", "d2").unionByName(selves)


def radius_join(queries: DataFrame, points: DataFrame, r2: float, block: int = BLOCK) -> DataFrame:
    """(id, nbr, d2) of all points with a squared distance strictly below r2."""

    def within(pair, ids, nbrs):
        i, j, d2 = pair.below(r2)
        return i[d2 < r2], j[d2 < r2], d2[d2 < r2]

    return _blockwise(queries, points, within, block)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def grid_radius_join(queries: DataFrame, points: DataFrame, r: float, dim: int) -> DataFrame:
    """radius_join for few dimensions: an equi-join on the 3^dim cells around a query, cells as wide as the radius."""
    cells = lambda offsets: [F.floor(F.col("x")[d] / r) + o for d, o in enumerate(offsets)]
    key = lambda offsets: F.struct(*[c.alias(f"c{d}") for d, c in enumerate(cells(offsets))])
    around = F.array(*[key(o) for o in product((-1, 0, 1), repeat=dim)])
    left = queries.select("id", F.col("x").alias("_a"), F.explode(around).alias("cell"))
    right = points.select(F.col("id").alias("nbr"), F.col("x").alias("_b"), key((0,) * dim).alias("cell"))
    return left.join(right, "cell").select("id", "nbr", squared_distance("_a", "_b").alias("d2")).filter(F.col("d2") < r * r)


def exists_in_sphere(queries: DataFrame, points: DataFrame, r2: float, strict: bool = True, block: int = BLOCK) -> DataFrame:
    """(id, found): whether another point lies within the squared radius (strictly, or not)."""

    def one(pair, ids, nbrs):
        i, j, d2 = pair.below(r2)
        hit = ((d2 < r2) if strict else (d2 <= r2)) & (ids[i] != nbrs[j])
        i, at = np.unique(i[hit], return_index=True)
        return i, j[hit][at], d2[hit][at]

    hits = _blockwise(queries, points, one, block).select("id").distinct().withColumn("found", F.lit(True))
    return queries.select("id").join(hits, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def spacing(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row: least, greatest and mean distance to the closest other point."""
    nearest = knn(points, points, 2, block).filter(F.col("nbr") != F.col("id")).groupBy("id").agg(F.min("d2").alias("d2"))
    return nearest.agg(F.sqrt(F.min("d2")).alias("min_dist"), F.sqrt(F.max("d2")).alias("max_dist"), F.avg(F.sqrt("d2")).alias("mean_dist"))


def shepard(neighbours: DataFrame, values: DataFrame, power: float = 2.0, reg: float = 0.0, conf_dist: float = 0.0) -> DataFrame:
    """(id, v): inverse-distance interpolation over neighbour lists; a node within conf_dist gives its value itself."""
    joined = neighbours.join(values.select(F.col("idx").alias("nbr"), F.col("v").alias("_v")), "nbr")
    w = 1.0 / (F.sqrt(F.pow("d2", F.lit(power))) + reg)
    sums = joined.groupBy("id").agg(
        F.min(F.struct("d2", "nbr", "_v")).alias("_near"),
        (F.sum(F.when(F.col("d2") > 0, w * F.col("_v"))) / F.sum(F.when(F.col("d2") > 0, w))).alias("_mean"),
    )
    return sums.select("id", F.when(F.sqrt(F.col("_near.d2")) <= conf_dist, F.col("_near._v")).otherwise(F.col("_mean")).alias("v"))


def symmetric_graph(neighbours: DataFrame) -> DataFrame:
    """(src, dst, w): neighbour edges and their reverses, duplicates summed, no loops."""
    edges = neighbours.filter(F.col("id") != F.col("nbr")).select(F.col("id").alias("src"), F.col("nbr").alias("dst"))
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def partition_of_unity(neighbours: DataFrame, approximations: DataFrame, radius_factor: float) -> DataFrame:
    """(id, v) at query points: neighbours(id, nbr, d2) with approximations(id, nbr, approx), weighted; nodes contribute strictly within their reach.

    neighbours has a column reach2: the squared distance of the node's farthest support point.
    """
    inside = neighbours.join(approximations, ["id", "nbr"]).filter(F.col("d2") < radius_factor * radius_factor * F.col("reach2"))
    w = 1.0 - F.sqrt(F.col("d2") / (radius_factor * radius_factor * F.col("reach2")))
    return inside.groupBy("id").agg((F.sum(w * F.col("approx")) / F.sum(w)).alias("v"))


def poisson_disk_subset(points: DataFrame, spacing2: float, strip: float) -> DataFrame:
    """A subset in which no two points are closer than the spacing, by priority of id.

    Rounds of local minima: a point is kept if no undecided point within the spacing has a smaller id, and
    removes its neighbours; each round is one join on the grid, and a few rounds settle all.
    """
    from ..session import cut_lineage

    close = cut_lineage(grid_radius_join(points, points, spacing2**0.5, 2).filter(F.col("id") != F.col("nbr")).select("id", "nbr"))
    undecided, kept = points.select("id"), None
    while True:
        live = close.join(undecided, "id", "left_semi").join(undecided.select(F.col("id").alias("nbr")), "nbr", "left_semi")
        beaten = live.filter(F.col("nbr") < F.col("id")).select("id").distinct()
        won = cut_lineage(undecided.join(beaten, "id", "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        lost = close.join(won.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("id").distinct()
        undecided = cut_lineage(undecided.join(won, "id", "left_anti").join(lost, "id", "left_anti"))
        if not undecided.limit(1).count():
            return kept.join(points, "id")
