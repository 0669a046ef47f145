"""Meshless discretization: nodes, stencil weights, differential operators, assembly, time stepping.

Stencils are small dense systems, one for each node, solved in Arrow batches of
nodes (a grouped pass over neighbour lists). Explicit operators are then sparse
products, and implicit ones are coordinate tables for the solvers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stencil sizes by monomial degree 0 to 5, and the orders of the polyharmonic splines.
STENCIL_SIZES = [0, 10, 22, 43, 74, 116]
SPLINE_ORDERS = [0, 1, 3, 3, 3, 5]


def box_nodes(spark: SparkSession, lo: list[float], hi: list[float], counts: list[int]) -> DataFrame:
    """nodes(id, x, type, normal) of a box: type 1 inside, -(2 axis + side + 1) on its faces."""
    from .ranges import grid

    g = grid(spark, lo, hi, counts)
    kind, normal = F.lit(1), F.lit(None).cast("array<double>")
    for d in reversed(range(len(counts))):
        step = (hi[d] - lo[d]) / (counts[d] - 1)
        for side, at in ((0, lo[d]), (1, hi[d])):
            on = F.abs(F.col("x")[d] - at) < step / 2
            kind = F.when(on, -(2 * d + side + 1)).otherwise(kind)
            unit = F.array(*[F.lit(float((2 * side - 1) * (i == d))) for i in range(len(counts))])
            normal = F.when(on, unit).otherwise(normal)
    return g.withColumn("type", kind).withColumn("normal", normal)


def in_box(x: Column, lo: list[float], hi: list[float], margin: float = 0.0) -> Column:
    out = F.lit(True)
    for d in range(len(lo)):
        out = out & (x[d] > lo[d] + margin) & (x[d] < hi[d] - margin)
    return out


def in_ball(x: Column, centre: list[float], radius: float) -> Column:
    return sum(((x[d] - c) ** 2 for d, c in enumerate(centre)), F.lit(0.0)) < radius * radius


def in_polygon(x: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule: the number of edges that a ray to the right crosses. Points on an edge are outside, as those on the faces of boxes and balls are."""
    inside, edge = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        within = x[0].between(min(ax, bx), max(ax, bx)) & x[1].between(min(ay, by), max(ay, by))
        edge = edge | within & ((bx - ax) * (x[1] - ay) == (by - ay) * (x[0] - ax))
        if ay == by:
            continue
        crosses = ((F.lit(ay) > x[1]) != (F.lit(by) > x[1])) & (x[0] < (bx - ax) * (x[1] - ay) / (by - ay) + ax)
        inside = inside != crosses
    return inside & ~edge


def ghost_nodes(nodes: DataFrame, h: float, first_id: int, kind: int = 2) -> DataFrame:
    """For each boundary node a node outside: x + h * normal. Its id is first_id plus the node's."""
    moved = F.zip_with("x", "normal", lambda a, b: a + h * b)
    return nodes.filter("type < 0").select((F.col("id") + first_id).alias("id"), moved.alias("x"), F.lit(kind).alias("type"), "normal")


def monomials(dim: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of all monomials of total degree up to `degree`, by degree."""
    return sorted((e for e in product(range(degree + 1), repeat=dim) if sum(e) <= degree), key=lambda e: (sum(e), tuple(-i for i in e)))


def _monomial_at_zero(e: tuple[int, ...], op: str) -> float:
    """An operator applied to a monomial, at 0."""
    if op == "value":
        return float(sum(e) == 0)
    if op == "lap":
        return 2.0 if sum(e) == 2 and 2 in e else 0.0
    axes = [int(c) for c in op[1:]]
    want = [axes.count(i) for i in range(len(e))]
    return float(np.prod([np.prod(range(1, i + 1)) for i in e])) if list(e) == want else 0.0


def _phs(d: np.ndarray, k: int, op: str) -> np.ndarray:
    """The operator, in the first argument, applied to |0 - y|^k for each row y of d."""
    r = np.sqrt((d * d).sum(axis=1))
    safe = np.where(r > 0, r, 1.0)
    if op == "value":
        return r**k
    if op == "lap":
        return k * (k + d.shape[1] - 2) * np.where(r > 0, safe ** (k - 2), 0.0)
    axes = [int(c) for c in op[1:]]
    first = k * np.where(r > 0, safe ** (k - 2), 0.0)
    if len(axes) == 1:
        return -first * d[:, axes[0]]
    second = k * (k - 2) * np.where(r > 0, safe ** (k - 4), 0.0) * d[:, axes[0]] * d[:, axes[1]]
    return second + (first if axes[0] == axes[1] else 0.0)


def stencil(points: np.ndarray, ops: list[str], degree: int, k: int) -> np.ndarray:
    """RBF-FD weights of the operators at points[0]: the saddle system of splines and monomials, in scaled local coordinates."""
    d = points - points[0]
    size = np.sqrt((d * d).sum(axis=1)).max() or 1.0
    d = d / size
    n, e = len(d), monomials(d.shape[1], degree)
    r = np.sqrt(((d[:, None] - d[None]) ** 2).sum(axis=2))
    P = np.stack([np.prod(d**np.array(q), axis=1) for q in e], axis=1)
    A = np.block([[r**k, P], [P.T, np.zeros((len(e), len(e)))]])
    rhs = np.stack([np.concatenate([_phs(d, k, op), [_monomial_at_zero(q, op) for q in e]]) for op in ops], axis=1)
    w = np.linalg.lstsq(A, rhs, rcond=None)[0][:n]
    order = {"value": 0, "lap": 2}
    return (w / np.array([size ** order.get(op, len(op) - 1) for op in ops])).T


def wls_stencil(points: np.ndarray, ops: list[str], degree: int, sigma: float = 1.0) -> np.ndarray:
    """Weighted least-squares weights with Gaussian weights; needs at least as many points as monomials."""
    d = points - points[0]
    size = np.sqrt((d * d).sum(axis=1)).max() or 1.0
    d = d / size
    e = monomials(d.shape[1], degree)
    if len(e) > len(d):
        raise ValueError("fewer support points than basis functions")
    w = np.exp(-(d * d).sum(axis=1) / sigma**2)
    B = np.stack([np.prod(d**np.array(q), axis=1) for q in e], axis=1) * w[:, None]
    rhs = np.stack([[_monomial_at_zero(q, op) for q in e] for op in ops], axis=1)
    order = {"value": 0, "lap": 2}
    return ((w[:, None] * (np.linalg.pinv(B).T @ rhs)) / np.array([size ** order.get(op, len(op) - 1) for op in ops])).T


def weights(neighbours: DataFrame, nodes: DataFrame, ops: list[str], degree: int = 2, k: int = 3, method: str = "rbf") -> DataFrame:
    """(op, node, ord, nbr, w) for neighbours(id, ord, nbr, d2); ops among value, lap, d0, d1, d01, ..."""
    listed = neighbours.join(nodes.select(F.col("id").alias("nbr"), "x"), "nbr").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", "nbr", "x"))).alias("s"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solve = (lambda p: stencil(p, ops, degree, k)) if method == "rbf" else (lambda p: wls_stencil(p, ops, degree))
        for f in frames:
            out = []
            for node, s in zip(f["id"], f["s"], strict=True):
                w = solve(np.array([list(p["x"]) for p in s]))
                for op, row in zip(ops, w, strict=True):
                    out += [(op, node, p["ord"], p["nbr"], v) for p, v in zip(s, row, strict=True)]
            yield pd.DataFrame(out, columns=["op", "node", "ord", "nbr", "w"])

    return listed.mapInPandas(run, "op string, node long, ord int, nbr long, w double")


def apply(w: DataFrame, op: str, field: DataFrame) -> DataFrame:
    """(idx, v): an operator applied to a field(idx, v)."""
    joined = w.filter(F.col("op") == op).join(field.select(F.col("idx").alias("nbr"), "v"), "nbr")
    return joined.groupBy(F.col("node").alias("idx")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def gradient(w: DataFrame, field: DataFrame, dim: int) -> DataFrame:
    """(idx, axis, v)."""
    joined = w.filter(F.col("op").isin([f"d{i}" for i in range(dim)])).join(field.select(F.col("idx").alias("nbr"), "v"), "nbr")
    return joined.groupBy(F.col("node").alias("idx"), F.substring("op", 2, 1).cast("int").alias("axis")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def divergence(w: DataFrame, field: DataFrame) -> DataFrame:
    """(idx, v) of a vector field(idx, axis, v)."""
    each = field.select(F.col("idx").alias("nbr"), F.concat(F.lit("d"), F.col("axis")).alias("op"), "v")
    return w.join(each, ["op", "nbr"]).groupBy(F.col("node").alias("idx")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def curl(w: DataFrame, field: DataFrame) -> DataFrame:
    """(idx, axis, v) in three dimensions: axis i is d_j v_k - d_k v_j."""
    terms = [(0, 1, 2, 1.0), (0, 2, 1, -1.0), (1, 2, 0, 1.0), (1, 0, 2, -1.0), (2, 0, 1, 1.0), (2, 1, 0, -1.0)]
    parts = None
    for out, by, of, sign in terms:
        f = field.filter(F.col("axis") == of).select(F.col("idx").alias("nbr"), (F.lit(sign) * F.col("v")).alias("v"))
        part = w.filter(F.col("op") == f"d{by}").join(f, "nbr").select(F.col("node").alias("idx"), F.lit(out).alias("axis"), (F.col("w") * F.col("v")).alias("v"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("idx", "axis").agg(F.sum("v").alias("v"))


def neumann(w: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row, col, val): the derivative along the normal at boundary nodes."""
    n = nodes.filter("type < 0").select(F.col("id").alias("node"), F.posexplode("normal").alias("axis", "c")).withColumn("op", F.concat(F.lit("d"), F.col("axis")))
    return w.join(n, ["node", "op"]).groupBy(F.col("node").alias("row"), F.col("nbr").alias("col")).agg(F.sum(F.col("w") * F.col("c")).alias("val"))


def assemble(w: DataFrame, terms: dict[str, float], rows: DataFrame) -> DataFrame:
    """(row, col, val) of a combination of operators on the rows(id): the left side of an implicit equation."""
    factor = F.coalesce(*[F.when(F.col("op") == op, F.lit(float(c))) for op, c in terms.items()])
    kept = w.filter(F.col("op").isin(list(terms))).join(rows.select(F.col("id").alias("node")), "node", "left_semi")
    return kept.groupBy(F.col("node").alias("row"), F.col("nbr").alias("col")).agg(F.sum(factor * F.col("w")).alias("val"))


def convection_diffusion(w: DataFrame, velocity: DataFrame, viscosity: float, dim: int) -> DataFrame:
    """(row, col, val) of -viscosity * Laplacian + velocity . gradient; velocity(idx, axis, v)."""
    each = velocity.select(F.col("idx").alias("node"), F.concat(F.lit("d"), F.col("axis")).alias("op"), F.col("v").alias("c"))
    factor = F.when(F.col("op") == "lap", F.lit(-float(viscosity))).otherwise(F.col("c"))
    terms = w.join(each, ["node", "op"], "left").select(F.col("node").alias("row"), F.col("nbr").alias("col"), (factor * F.col("w")).alias("val"))
    return terms.filter("val IS NOT NULL").groupBy("row", "col").agg(F.sum("val").alias("val"))


def dirichlet_rows(nodes: DataFrame) -> DataFrame:
    """Identity rows for boundary nodes."""
    return nodes.filter("type < 0").select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))


def hyperviscosity(w: DataFrame, spacing: float, order: int, strength: float) -> DataFrame:
    """(row, col, val) of (-1)^(order + 1) * strength * spacing^(2 order) * Laplacian^order."""
    from .linalg import scale, spmm

    lap = w.filter("op = 'lap'").select(F.col("node").alias("row"), F.col("nbr").alias("col"), F.col("w").alias("val"))
    out = lap
    for _ in range(order - 1):
        out = spmm(out, lap)
    return scale(out, (-1.0) ** (order + 1) * strength * spacing ** (2 * order))


def hyperviscous(neighbours: DataFrame, values: DataFrame, order: int, strength: float, degree: int, k: int) -> DataFrame:
    """(idx, v): hyperviscosity's matrix over spacing^(2 order), times a field: Laplacian by Laplacian, so no power of the matrix is made.

    values(id, x, v), and v_lo if a double's digits are too few for differences on so fine a spacing (approx.fine_values).
    """
    from .approx import by_size, operator, read_supports, stacked_weights, supports

    lap, lists = [operator("lap")], ["nbr", "w"]

    def run(batches):
        for batch in batches:
            sizes, s = read_supports(batch)
            ids, first = batch.column("id").to_numpy(), np.cumsum(sizes) - sizes
            for places in by_size(sizes):
                n = int(sizes[places[0]])
                of = first[places][:, None] + np.arange(n)
                y, v, low = s["y"][of], s["v"][of], s["v_lo"][of]
                w = stacked_weights(y - y[:, :1], lap, degree, k)[:, 0]
                once = (w * ((v - v[:, :1]) + (low - low[:, :1]))).sum(axis=1)
                ends = pa.array(np.arange(0, n * len(places) + 1, n, dtype=np.int32))
                kept = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(a).ravel())) for a in (s["nbr"][of], w)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[places]), pa.array(once), *kept], names=["node", "v", *lists])

    found = supports(neighbours, values, "nbr").mapInArrow(run, "node long, v double, nbr array<long>, w array<double>")
    # Only a third power reads the weights again.
    found = found.persist(StorageLevel.DISK_ONLY) if order > 2 else found
    field = found
    for step in range(order - 1):
        if step:
            field = found.drop("v").join(field, "node", "left")
        # A node's value and the weights it gets are dealt as one table, so the stencils are solved once and kept nowhere.
        own = F.struct(F.col("node").alias("key"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("w"), "v")
        given = F.transform(F.arrays_zip("nbr", "w"), lambda z: F.struct(z["nbr"].alias("key"), F.col("node").alias("node"), z["w"].alias("w"), F.lit(None).cast("double").alias("v")))
        dealt = field.select(F.explode(F.concat(F.array(own), given)).alias("e")).select("e.*").repartition("key")
        met = dealt.groupBy("key").agg(F.max("v").alias("v"), F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", "w"))).alias("to"))
        field = met.select("v", F.explode("to").alias("e")).groupBy(F.col("e.node").alias("node")).agg(F.sum(F.col("e.w") * F.col("v")).alias("v"))
    return field.select(F.col("node").alias("idx"), (F.lit((-1.0) ** (order + 1) * strength) * F.col("v")).alias("v"))


# Butcher tables (nodes, coefficients, weights), and Adams-Bashforth weights, the latest step first.
TABLEAUS = {
    "euler": ([0.0], [[]], [1.0]),
    "midpoint": ([0.0, 0.5], [[], [0.5]], [0.0, 1.0]),
    "rk3": ([0.0, 0.5, 1.0], [[], [0.5], [-1.0, 2.0]], [1 / 6, 2 / 3, 1 / 6]),
    "rk4": ([0.0, 0.5, 0.5, 1.0], [[], [0.5], [0.0, 0.5], [0.0, 0.0, 1.0]], [1 / 6, 1 / 3, 1 / 3, 1 / 6]),
    "rk38": ([0.0, 1 / 3, 2 / 3, 1.0], [[], [1 / 3], [-1 / 3, 1.0], [1.0, -1.0, 1.0]], [1 / 8, 3 / 8, 3 / 8, 1 / 8]),
    "fehlberg5": (
        [0.0, 1 / 4, 3 / 8, 12 / 13, 1.0, 1 / 2],
        [[], [1 / 4], [3 / 32, 9 / 32], [1932 / 2197, -7200 / 2197, 7296 / 2197], [439 / 216, -8.0, 3680 / 513, -845 / 4104], [-8 / 27, 2.0, -3544 / 2565, 1859 / 4104, -11 / 40]],
        [16 / 135, 0.0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55],
    ),
}
ADAMS = {1: [1.0], 2: [3 / 2, -1 / 2], 3: [23 / 12, -4 / 3, 5 / 12], 4: [55 / 24, -59 / 24, 37 / 24, -3 / 8], 5: [1901 / 720, -1387 / 360, 109 / 30, -637 / 360, 251 / 720]}


def runge_kutta(f: Callable[[float, np.ndarray], np.ndarray], y: np.ndarray, t0: float, t1: float, steps: int, method: str = "rk4") -> np.ndarray:
    """y at t1; y may be a vector or rows of many series."""
    c, a, b = TABLEAUS[method]
    h, y = (t1 - t0) / steps, np.array(y, float)
    for i in range(steps):
        t, ks = t0 + i * h, []
        for ci, ai in zip(c, a, strict=True):
            ks.append(f(t + ci * h, y + h * sum((x * k for x, k in zip(ai, ks, strict=True)), np.zeros_like(y))))
        y = y + h * sum(x * k for x, k in zip(b, ks, strict=True))
    return y


def adams_bashforth(f: Callable[[float, np.ndarray], np.ndarray], y: np.ndarray, t0: float, t1: float, steps: int, order: int = 4) -> np.ndarray:
    """y at t1; the first steps are Runge-Kutta steps of order 4."""
    h, y, past = (t1 - t0) / steps, np.array(y, float), []
    for i in range(steps):
        t = t0 + i * h
        past = [f(t, y), *past][:order]
        y = y + h * sum(w * g for w, g in zip(ADAMS[order], past, strict=True)) if len(past) == order else runge_kutta(f, y, t, t + h, 1)
    return y


def integrate_series(series: DataFrame, f: Callable[[float, np.ndarray], np.ndarray], t1: float, steps: int, method: str = "rk4") -> DataFrame:
    """(id, y) of independent initial values series(id, y): batches of series advance together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            y = np.array([list(v) for v in x["y"]]) if len(x) else np.zeros((0, 1))
            done = runge_kutta(f, y, 0.0, t1, steps, method) if method in TABLEAUS else adams_bashforth(f, y, 0.0, t1, steps)
            yield pd.DataFrame({"id": x["id"], "y": list(done)})

    return series.select("id", "y").mapInPandas(run, "id long, y array<double>")


# Finite elements on triangles.


def unit_square_mesh(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """vertices(id, x) of an (n + 1)^2 grid and triangles(id, v) of its halved cells."""
    from .ranges import grid

    vertices = grid(spark, [0.0, 0.0], [1.0, 1.0], [n + 1, n + 1])
    cell = spark.range(2 * n * n).withColumn("_c", F.floor(F.col("id") / 2)).withColumn("_v", F.floor(F.col("_c") / n) * (n + 1) + F.col("_c") % n)
    low = F.array(F.col("_v"), F.col("_v") + n + 1, F.col("_v") + n + 2)
    high = F.array(F.col("_v"), F.col("_v") + n + 2, F.col("_v") + 1)
    return vertices, cell.select("id", F.when(F.col("id") % 2 == 0, low).otherwise(high).alias("v"))


def p1_stiffness(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(row, col, val) of piecewise linear elements; element matrices are expressions, assembly is a sum."""
    t = triangles
    for i in range(3):
        t = t.withColumn(f"v{i}", F.col("v")[i]).join(vertices.select(F.col("id").alias(f"v{i}"), F.col("x").alias(f"p{i}")), f"v{i}")
    edge = lambda i, d: F.col(f"p{(i + 2) % 3}")[d] - F.col(f"p{(i + 1) % 3}")[d]
    area2 = F.abs(edge(0, 0) * edge(1, 1) - edge(0, 1) * edge(1, 0))
    entries = [F.struct(F.col(f"v{i}").alias("row"), F.col(f"v{j}").alias("col"), ((edge(i, 0) * edge(j, 0) + edge(i, 1) * edge(j, 1)) / (2 * area2)).alias("val")) for i in range(3) for j in range(3)]
    return t.select(F.explode(F.array(*entries)).alias("e")).select("e.*").groupBy("row", "col").agg(F.sum("val").alias("val"))


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """(a, b, n): the edges of triangles, each once, with the number of triangles that share it."""
    e = [F.struct(F.least(F.col("v")[i], F.col("v")[j]).alias("a"), F.greatest(F.col("v")[i], F.col("v")[j]).alias("b")) for i, j in ((0, 1), (1, 2), (2, 0))]
    return triangles.select(F.explode(F.array(*e)).alias("e")).select("e.*").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
