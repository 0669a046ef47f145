"""H2-matrices: kernels interpolated at Chebyshev points, nested cluster bases, and their transforms.

A cluster's basis is the tensor interpolation at m points an axis of its box, so a
son's basis is its father's times a transfer matrix that depends on both boxes
alone: nothing but boxes is stored. A product goes up the tree (a sum over sons for
each level), across the admissible blocks (a join), down the tree, and over the
near field's entries; each is a grouped sum, and coefficients are m^d numbers a cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def chebyshev(m: int, lo: float, hi: float) -> np.ndarray:
    x = np.cos((2 * np.arange(m) + 1) * np.pi / (2 * m))
    return (lo + hi) / 2 + (hi - lo) / 2 * x


def _lagrange(m: int, lo: float, hi: float, x: np.ndarray) -> np.ndarray:
    """The m Lagrange polynomials of the Chebyshev points, at x; 1 / m of each where a box has no extent."""
    if hi <= lo:
        return np.full((len(x), m), 1.0 / m)
    p = chebyshev(m, lo, hi)
    out = np.ones((len(x), m))
    for k in range(m):
        for j in range(m):
            if j != k:
                out[:, k] *= (x - p[j]) / (p[k] - p[j])
    return out


def grid_points(m: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.array(list(product(*[chebyshev(m, a, b) for a, b in zip(lo, hi, strict=True)])))


def interpolation(m: int, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of the basis of a box at points x: len(x) by m^d."""
    out = np.ones((len(x), 1))
    for d in range(x.shape[1]):
        out = (out[:, :, None] * _lagrange(m, lo[d], hi[d], x[:, d])[:, None, :]).reshape(len(x), -1)
    return out


def _boxed(nodes: DataFrame, axes: list[str], prefix: str = "") -> DataFrame:
    return nodes.select(F.col("node").alias(f"{prefix}node"), F.array(*[f"min_{a}" for a in axes]).alias(f"{prefix}lo"), F.array(*[f"max_{a}" for a in axes]).alias(f"{prefix}hi"))


_COEFFICIENTS = "node long, c array<double>"


def _summed(parts: DataFrame) -> DataFrame:
    """Coefficients added up by cluster, place by place."""
    each = parts.select("node", F.posexplode("c").alias("at", "v")).groupBy("node", "at").agg(F.sum("v").alias("v"))
    return each.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("c"))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in column])


def forward(points: DataFrame, nodes: DataFrame, axes: list[str], x: DataFrame, m: int) -> DataFrame:
    """(node, c) of all clusters: V^T x, from the leaves up. points(id, node, x array) with leaf numbers, x(idx, v)."""
    leaf = points.join(x.select(F.col("idx").alias("id"), "v"), "id").join(_boxed(nodes, axes), "node")

    def anterpolated(frames):
        for f in frames:
            out = []
            for node, g in f.groupby("node"):
                lo, hi = np.asarray(g["lo"].iloc[0]), np.asarray(g["hi"].iloc[0])
                out.append((node, list(interpolation(m, lo, hi, _vectors(g["x"])).T @ g["v"].to_numpy())))
            yield pd.DataFrame(out, columns=["node", "c"])

    level = cut_lineage(_summed(leaf.mapInPandas(anterpolated, _COEFFICIENTS)))
    found, fathers, own = level, _boxed(nodes, axes, "f_"), _boxed(nodes, axes)
    deepest = int(nodes.agg(F.max("level")).first()[0])
    heights = nodes.select("node", "level")
    for at in range(deepest, 0, -1):
        up = found.join(heights.filter(F.col("level") == at).select("node"), "node").withColumn("f_node", F.shiftright("node", 1)).join(own, "node").join(fathers, "f_node")

        def raised(frames):
            for f in frames:
                # A son's points, in the basis of its father.
                out = [(int(r.f_node), list(interpolation(m, np.asarray(r.f_lo), np.asarray(r.f_hi), grid_points(m, np.asarray(r.lo), np.asarray(r.hi))).T @ np.asarray(r.c))) for r in f.itertuples(index=False)]
                yield pd.DataFrame(out, columns=["node", "c"])

        found = found.unionByName(cut_lineage(_summed(up.mapInPandas(raised, _COEFFICIENTS))))
    return found


def backward(points: DataFrame, nodes: DataFrame, axes: list[str], coefficients: DataFrame, m: int) -> DataFrame:
    """(idx, v): V c summed over all clusters, from the root down."""
    own, fathers = _boxed(nodes, axes), _boxed(nodes, axes, "f_")
    deepest = int(nodes.agg(F.max("level")).first()[0])
    heights, now = nodes.select("node", "level"), cut_lineage(coefficients)
    for at in range(1, deepest + 1):
        sons = heights.filter(F.col("level") == at).select("node").withColumn("f_node", F.shiftright("node", 1))
        down = sons.join(now.select(F.col("node").alias("f_node"), "c"), "f_node").join(own, "node").join(fathers, "f_node")

        def lowered(frames):
            for f in frames:
                out = [(int(r.node), list(interpolation(m, np.asarray(r.f_lo), np.asarray(r.f_hi), grid_points(m, np.asarray(r.lo), np.asarray(r.hi))) @ np.asarray(r.c))) for r in f.itertuples(index=False)]
                yield pd.DataFrame(out, columns=["node", "c"])

        now = cut_lineage(_summed(now.unionByName(down.mapInPandas(lowered, _COEFFICIENTS))))
    leaf = points.join(now, "node").join(own, "node")

    def interpolated(frames):
        for f in frames:
            out = []
            for _, g in f.groupby("node"):
                lo, hi = np.asarray(g["lo"].iloc[0]), np.asarray(g["hi"].iloc[0])
                out.append(pd.DataFrame({"idx": g["id"], "v": interpolation(m, lo, hi, _vectors(g["x"])) @ np.asarray(g["c"].iloc[0])}))
            if out:
                yield pd.concat(out)

    return leaf.mapInPandas(interpolated, "idx long, v double")


def coupled(blocks: DataFrame, nodes: DataFrame, axes: list[str], coefficients: DataFrame, kernel: Kernel, m: int) -> DataFrame:
    """(node, c) of row clusters: the kernel between interpolation points times the coefficients, over admissible blocks(r_node, c_node)."""
    far = blocks.join(coefficients.select(F.col("node").alias("c_node"), "c"), "c_node").join(_boxed(nodes, axes, "r_"), "r_node").join(_boxed(nodes, axes, "c_"), "c_node")

    def run(frames):
        for f in frames:
            out = [(int(r.r_node), list(kernel(grid_points(m, np.asarray(r.r_lo), np.asarray(r.r_hi)), grid_points(m, np.asarray(r.c_lo), np.asarray(r.c_hi))) @ np.asarray(r.c))) for r in f.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["node", "c"])

    return _summed(far.select("r_node", "r_lo", "r_hi", "c_lo", "c_hi", "c").mapInPandas(run, _COEFFICIENTS))


def near(points: DataFrame, blocks: DataFrame, x: DataFrame, kernel: Kernel) -> DataFrame:
    """(idx, v) of the blocks that aren't admissible, which are of leaves and so of bounded size."""
    leaf = points.groupBy("node").agg(F.collect_list("id").alias("ids"), F.collect_list("x").alias("xs"))
    valued = points.join(x.select(F.col("idx").alias("id"), "v"), "id").groupBy("node").agg(F.collect_list("x").alias("ys"), F.collect_list("v").alias("vs"))
    met = blocks.join(leaf.withColumnRenamed("node", "r_node"), "r_node").join(valued.withColumnRenamed("node", "c_node"), "c_node")

    def run(frames):
        for f in frames:
            if len(f):
                values = [kernel(_vectors(r.xs), _vectors(r.ys)) @ np.asarray(r.vs) for r in f.itertuples(index=False)]
                yield pd.DataFrame({"idx": np.concatenate(list(f["ids"])), "v": np.concatenate(values)})

    return met.select("ids", "xs", "ys", "vs").mapInPandas(run, "idx long, v double")


def leaf_blocks(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that aren't admissible, as pairs of leaves: a block with one leaf meets the other side's leaves below it."""
    leaves = nodes.filter("leaf").select(F.col("node").alias("leaf_node"), F.explode(F.expr("transform(sequence(0, level), d -> shiftright(node, d))")).alias("up"))
    side = lambda name: leaves.select(F.col("up").alias(f"{name}_node"), F.col("leaf_node").alias(f"_{name}"))
    return blocks.join(side("r"), "r_node").join(side("c"), "c_node").select(F.col("_r").alias("r_node"), F.col("_c").alias("c_node"))


def matvec(points: DataFrame, nodes: DataFrame, axes: list[str], blocks: DataFrame, kernel: Kernel, x: DataFrame, m: int = 5) -> DataFrame:
    """(idx, v) of the kernel's H2-matrix times x(idx, v). blocks: leaves of the block tree."""
    nodes = cut_lineage(nodes)  # every level of both transforms reads it
    leaves = blocks.filter("leaf")
    found = coupled(leaves.filter("admissible").select("r_node", "c_node"), nodes, axes, forward(points, nodes, axes, x, m), kernel, m)
    far = backward(points, nodes, axes, found, m)
    return far.unionByName(near(points, leaf_blocks(nodes, leaves.filter("NOT admissible").select("r_node", "c_node")), x, kernel)).groupBy("idx").agg(F.sum("v").alias("v"))
