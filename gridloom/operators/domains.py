"""Node sets as domains: fills, unions and differences, relaxation, refinement, balanced and restricted supports, dissections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import spatial

#: The effective factor of the squared spacing under which nodes of joined domains are too close.
TOO_CLOSE = 0.75


def grid_fill(spark: SparkSession, inside: Column, lo: list[float], hi: list[float], h: float, others: DataFrame | None = None) -> DataFrame:
    """(id, x) of the points of a grid of width h that are inside and at least h from the points of others(id, x)."""
    from .ranges import grid

    counts = [int((b - a) / h) + 1 for a, b in zip(lo, hi, strict=True)]
    top = [a + (n - 1) * h for a, n in zip(lo, counts, strict=True)]
    candidates = grid(spark, lo, top, counts).filter(inside)
    if others is None:
        return candidates
    near = spatial.grid_radius_join(candidates, others, h, len(lo)).select("id").distinct()
    return candidates.join(near, "id", "left_anti")


def union(first: DataFrame, second: DataFrame, in_first: Column, spacing: float, dim: int) -> DataFrame:
    """Nodes of the first, and those of the second that are outside the first's shape and not too close to its nodes."""
    outside = second.filter(~in_first)
    close = spatial.grid_radius_join(outside.select("id", "x"), first.select("id", "x"), (TOO_CLOSE**0.5) * spacing, dim).select("id").distinct()
    return first.unionByName(outside.join(close, "id", "left_anti"))


def difference(first: DataFrame, second: DataFrame, in_second: Column, spacing: float, dim: int) -> DataFrame:
    """Nodes of the first that are outside the second's shape and not too close to its nodes."""
    outside = first.filter(~in_second)
    close = spatial.grid_radius_join(outside.select("id", "x"), second.select("id", "x"), (TOO_CLOSE**0.5) * spacing, dim).select("id").distinct()
    return outside.join(close, "id", "left_anti")


def relax(nodes: DataFrame, k: int, steps: int, strength: float, inside: Column) -> DataFrame:
    """Inner nodes pushed from their k nearest, less at each step; nodes that would leave stay where they were. nodes(id, x, type)."""
    now = nodes
    for i in range(steps):
        near = spatial.knn(now.filter("type > 0").select("id", "x"), now.select("id", "x"), k + 1).filter("nbr <> id")
        joined = near.join(now.select("id", F.col("x").alias("_a")), "id").join(now.select(F.col("id").alias("nbr"), F.col("x").alias("_b")), "nbr")
        push = joined.select("id", F.posexplode(F.zip_with("_a", "_b", lambda a, b: a - b)).alias("axis", "d"), "d2")
        force = push.groupBy("id", "axis").agg(F.sum(F.col("d") / (F.col("d2") * F.col("d2") + 1e-30)).alias("f"), F.min("d2").alias("m"))
        moved = force.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("axis", "f"))).alias("s"), F.min("m").alias("m"))
        size = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, e: t + e["f"] * e["f"]))
        step = moved.select("id", F.transform("s", lambda e: e["f"] / (size + 1e-30) * F.sqrt("m") * F.lit(strength * (1 - i / steps))).alias("_step"))
        shifted = now.join(step, "id", "left").withColumn("_old", F.col("x")).withColumn("x", F.when(F.col("_step").isNull(), F.col("x")).otherwise(F.zip_with("x", "_step", lambda a, b: a + b)))
        now = cut_lineage(shifted.withColumn("x", F.when((F.col("type") > 0) & ~inside, F.col("_old")).otherwise(F.col("x"))).select(*nodes.columns))
    return now


def refine(nodes: DataFrame, region: Column, k: int, fraction: float, first_id: int) -> DataFrame:
    """Middles of the links of nodes in a region that are farther from all nodes than the fraction of the link's length. (id, x)."""
    chosen = nodes.filter(region).select("id", "x")
    links = spatial.knn(chosen, nodes.select("id", "x"), k + 1).filter("nbr <> id").select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"), "d2").distinct()
    middles = links.join(nodes.select(F.col("id").alias("a"), F.col("x").alias("_a")), "a").join(nodes.select(F.col("id").alias("b"), F.col("x").alias("_b")), "b")
    middles = cut_lineage(middles.select(F.xxhash64("a", "b").alias("id"), "a", "b", "d2", F.zip_with("_a", "_b", lambda x, y: (x + y) / 2).alias("x")))
    nearest = spatial.knn(middles.select("id", "x"), nodes.select("id", "x"), 1).select("id", F.col("d2").alias("m"))
    kept = middles.join(nearest, "id").filter(F.col("m") >= fraction * fraction * F.col("d2") * 0.999999)
    return _numbered(kept, ["a", "b"], first_id).select("id", "x")


def _numbered(df: DataFrame, order: list[str], first_id: int, width: int = 1 << 14) -> DataFrame:
    """`df` with ids from first_id in the order of its columns: ranks within blocks of the first one, added to the blocks' starts."""
    blocked = df.drop("id").withColumn("_b", F.floor(F.col(order[0]) / width))
    starts = blocked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1
    return blocked.withColumn("_r", rank).join(starts, "_b").withColumn("id", F.col("_start") + F.col("_r") + first_id).drop("_b", "_r", "_start")


def balanced_support(nodes: DataFrame, least: int, most: int) -> DataFrame:
    """(id, ord, nbr, d2): the shortest list of nearest nodes, of `least` or more, that covers all octants around a node; `most` at most."""
    near = spatial.knn(nodes.select("id", "x"), nodes.select("id", "x"), most)
    joined = near.join(nodes.select("id", F.col("x").alias("_a")), "id").join(nodes.select(F.col("id").alias("nbr"), F.col("x").alias("_b")), "nbr")
    octant = F.aggregate(F.zip_with("_a", "_b", lambda a, b: (b >= a).cast("int")), F.lit(0), lambda s, v: 2 * s + v)
    own = joined.select("id", "ord", "nbr", "d2", F.when(F.col("nbr") != F.col("id"), octant).alias("o"), F.size("_a").alias("dim"))
    first = own.filter("o IS NOT NULL").groupBy("id", "dim", "o").agg(F.min("ord").alias("at")).groupBy("id", "dim").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    size = first.select("id", F.when(F.col("n") == F.expr("shiftleft(1, dim)"), F.greatest(F.col("last") + 1, F.lit(least))).otherwise(most).alias("size"))
    return near.join(size, "id").filter(F.col("ord") < F.col("size")).select("id", "ord", "nbr", "d2")


def restricted_support(nodes: DataFrame, k: int, clusters: DataFrame) -> DataFrame:
    """(id, ord, nbr, d2): the k nearest among a node's own cluster, its ancestors' separators and all boundary nodes.

    clusters(id, node, separator): the leaf that a node lies in or, if separator, the inner node whose
    separator it belongs to; sons of a node are 2 node and 2 node + 1. An empty list of nodes to update
    means none here.
    """
    own = nodes.join(clusters, "id")
    ancestors = F.expr("transform(sequence(0, CAST(floor(log2(node)) AS INT)), d -> shiftright(node, d))")
    sees = own.filter("type > 0").select("id", "x", F.explode(ancestors).alias("c"))
    groups = own.select("id", "x", F.col("node").alias("c")).unionByName(nodes.filter("type < 0").select("id", "x", F.lit(0).cast("long").alias("c")))
    asks = sees.unionByName(own.filter("type > 0").select("id", "x", F.lit(0).cast("long").alias("c")))

    # Both sides of a group are cut into blocks, so a task holds two blocks whatever the size of the group.
    n_a = asks.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / spatial.BLOCK).cast("int").alias("na"))
    n_g = groups.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / spatial.BLOCK).cast("int").alias("nb"))
    blocks = cut_lineage(n_a.join(n_g, "c"))
    own_block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(blocks, "c").select("c", own_block("na").alias("i"), all_blocks("nb").alias("j"), "id", "x", F.lit(True).alias("asks"))
    right = groups.join(blocks, "c").select("c", all_blocks("na").alias("i"), own_block("nb").alias("j"), "id", "x", F.lit(False).alias("asks"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, p = rows[rows["asks"]], rows[~rows["asks"]].sort_values("id")
        if q.empty or p.empty:
            return pd.DataFrame({"id": [], "nbr": [], "d2": []}).astype({"id": "int64", "nbr": "int64", "d2": "float64"})
        a, b, out = np.stack(q["x"].to_numpy()), np.stack(p["x"].to_numpy()), []
        for i in range(0, len(a), 512):
            d2 = ((a[i : i + 512, None] - b[None]) ** 2).sum(axis=2)
            take = np.argsort(d2, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"id": np.repeat(q["id"].to_numpy()[i : i + 512], take.shape[1]), "nbr": p["id"].to_numpy()[take].ravel(), "d2": np.take_along_axis(d2, take, 1).ravel()}))
        return pd.concat(out)

    pairs = left.unionByName(right).groupBy("c", "i", "j").applyInPandas(run, "id long, nbr long, d2 double")
    return spatial.top_k(pairs.distinct(), k)


def _least_cover(near: dict[int, list[int]]) -> tuple[set[int], set[int]]:
    """Vertices of side 0 and of side 1 that meet all edges u: [v, ...], as many as a largest matching has edges."""
    mate: dict[int, int] = {}  # of vertices of side 1
    back: dict[int, int] = {}  # of vertices of side 0
    dead: set[int] = set()  # reached by searches that failed: no later one gets further there
    for start in near:
        # An alternating path from an unmatched vertex, breadth first.
        came: dict[int, int] = {}
        front, end = [start], None
        while front and end is None:
            later = []
            for u in front:
                for v in near[u]:
                    if v not in came and v not in dead:
                        came[v] = u
                        if v not in mate:
                            end = v
                            break
                        later.append(mate[v])
                if end is not None:
                    break
            front = later
        if end is None:
            dead.update(came)
        else:
            v: int | None = end
            while v is not None:
                u = came[v]
                mate[v], v, back[u] = u, back.get(u), v
    matched = set(mate.values())
    reach, front = set(u for u in near if u not in matched), [u for u in near if u not in matched]
    hit: set[int] = set()
    while front:
        later = []
        for u in front:
            for v in near[u]:
                if v not in hit:
                    hit.add(v)
                    if v in mate and mate[v] not in reach:
                        reach.add(mate[v])
                        later.append(mate[v])
        front = later
    return set(u for u in near if u not in reach), hit


#: Edges of each vertex that a round of minimum_separator brings to the driver, and the cut's size up to which all come at once.
_EACH, _AT_ONCE = 8, 200_000


def minimum_separator(edges: DataFrame, sides: DataFrame, most_edges: int = 2_000_000, at_once: int = _AT_ONCE) -> DataFrame:
    """(id): a least set of vertices that meets every edge between the sides, by a maximum matching of the cut.

    Of a cut of more than `at_once` edges the driver matches a part: a few edges of each vertex, then also a few of
    those that the part's least cover misses, until it misses none of the whole cut. That cover is as large as a
    matching, so none is smaller. ValueError if the part grows beyond `most_edges` edges.
    """
    spark = edges.sparkSession
    a = sides.filter("side = 0").select(F.col("id").alias("src"))
    b = sides.filter("side = 1").select(F.col("id").alias("dst"))
    cut = cut_lineage(edges.select("src", "dst").join(a, "src", "left_semi").join(b, "dst", "left_semi").distinct())

    def few(missed: DataFrame) -> DataFrame:
        first = lambda one, other: missed.withColumn("_n", F.row_number().over(W.partitionBy(one).orderBy(F.xxhash64(one, other), other))).filter(F.col("_n") <= _EACH).select("src", "dst")
        return first("src", "dst").unionByName(first("dst", "src")).distinct()

    near: dict[int, list[int]] = {}
    size, missed, whole = 0, cut, cut.limit(at_once + 1).count() <= at_once
    while True:
        rows = sorted((missed if whole else few(missed)).limit(max(0, most_edges - size) + 1).collect())
        size += len(rows)
        if size > most_edges:
            raise ValueError(f"more than {most_edges} edges of the cut are needed; graph.simple_separator gives a separator that isn't least")
        for r in rows:
            near.setdefault(r["src"], []).append(r["dst"])
        left, right = _least_cover(near)
        if whole or not rows:
            return spark.createDataFrame([(v,) for v in right] + [(u,) for u in near if u in left], "id long")
        of = lambda found, name: spark.createDataFrame([(v,) for v in found], f"{name} long")
        missed = cut_lineage(cut.join(of(left, "src"), "src", "left_anti").join(of(right, "dst"), "dst", "left_anti"))


def nested_dissection(points: DataFrame, edges: DataFrame, axes: list[str], levels: int, least: int) -> DataFrame:
    """`points` with node and separator: halves along the longest axis (ties left), separators split off, `levels` deep.

    All nodes of a level are dissected together: their halves by one aggregation, their separators by one
    join of the edges inside nodes. A half of fewer than `least` points isn't split further.
    """
    from .cluster import boxes

    now = cut_lineage(points.withColumn("node", F.lit(1).cast("long")).withColumn("separator", F.lit(False)))
    for level in range(levels):
        live = now.filter(~F.col("separator") & (F.col("node") >= (1 << level)))
        box = boxes(live, "node", axes).filter(F.col("size") >= least)
        extent = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes]
        longest = F.greatest(*extent) if len(axes) > 1 else extent[0]
        value, mid = F.lit(None).cast("double"), F.lit(None).cast("double")
        for i in reversed(range(len(axes))):
            value = F.when(extent[i] == longest, F.col(axes[i])).otherwise(value)
            mid = F.when(extent[i] == longest, (F.col(f"max_{axes[i]}") + F.col(f"min_{axes[i]}")) * 0.5).otherwise(mid)
        sided = cut_lineage(live.join(box.filter(longest > 0), "node").select("id", "node", (value > mid).cast("int").alias("side")))
        sizes = sided.groupBy("node").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
        scanned = sided.join(sizes, "node").filter(F.col("side") == F.when(F.col("n0") < F.col("n1"), 1).otherwise(0)).select(F.col("id").alias("src"), "node", "side")
        other = sided.select(F.col("id").alias("dst"), F.col("node").alias("_n"), F.col("side").alias("_s"))
        cut = edges.select("src", "dst").join(scanned, "src").join(other, "dst").filter((F.col("node") == F.col("_n")) & (F.col("side") != F.col("_s"))).select(F.col("src").alias("id"), F.lit(True).alias("_cut")).distinct()
        joined = now.join(sided.select("id", F.col("side").alias("_side")), "id", "left").join(cut, "id", "left")
        moved = F.when(F.col("_side").isNull() | F.col("_cut"), F.col("node")).otherwise(2 * F.col("node") + F.col("_side"))
        now = cut_lineage(joined.withColumn("node", moved).withColumn("separator", F.col("separator") | F.coalesce("_cut", F.lit(False))).select(*points.columns, "node", "separator"))
    return now


def polyhedron_volume_moments(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: volume and first moments of a closed polyhedron of outward triangles, as sums over its faces."""
    t = faces
    for i in range(3):
        t = t.withColumn(f"v{i}", F.col("v")[i]).join(vertices.select(F.col("id").alias(f"v{i}"), F.col("x").alias(f"p{i}")), f"v{i}")
    p = [[F.col(f"p{i}")[d] for d in range(3)] for i in range(3)]
    det = p[0][0] * (p[1][1] * p[2][2] - p[1][2] * p[2][1]) - p[0][1] * (p[1][0] * p[2][2] - p[1][2] * p[2][0]) + p[0][2] * (p[1][0] * p[2][1] - p[1][1] * p[2][0])
    return t.agg((F.sum(det) / 6).alias("volume"), *[(F.sum(det * (p[0][d] + p[1][d] + p[2][d])) / 24).alias(f"m{d}") for d in range(3)])


def lcg_vector(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(idx, v) of n pseudo-random numbers in [-0.5, 0.5): the minimal-standard generator, its i-th value by modular powers in each batch."""
    modulus, factor = 2147483647, 16807

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = seed * pow(factor, int(f["id"].iloc[0]) + 1, modulus) % modulus
                out = []
                for _ in range(len(f)):
                    out.append(x / modulus - 0.5)
                    x = x * factor % modulus
                yield pd.DataFrame({"idx": f["id"], "v": out})

    return spark.range(n).mapInPandas(run, "idx long, v double")
