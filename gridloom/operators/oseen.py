"""The Oseen problem: node sets, manufactured solutions, the saddle system and its diagnostics.

Unknowns are the velocity components of all velocity nodes, one component after the
other, then the pressures: idx = component * n_u + node, and dim * n_u + pressure node.
Everything is a table of entries; the system is a union of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import approx, pde, solvers
from . import spatial as sp

# Support sizes of the four stencils by monomial degree.
SUPPORTS = pde.STENCIL_SIZES
#: Stencils whose points are Python objects at a time.
ROWS = 256


def node_sets(spark: SparkSession, lo: list[float], hi: list[float], counts: list[int]) -> tuple[DataFrame, DataFrame]:
    """Velocity nodes (id, x, type, normal) of a box, and pressure nodes (id, x): the centres of its cells."""
    from .ranges import grid

    step = [(b - a) / (n - 1) for a, b, n in zip(lo, hi, counts, strict=True)]
    pressure = grid(spark, [a + h / 2 for a, h in zip(lo, step, strict=True)], [b - h / 2 for b, h in zip(hi, step, strict=True)], [n - 1 for n in counts])
    return pde.box_nodes(spark, lo, hi, counts), pressure.select("id", "x")


def swirl(x: Column) -> list[Column]:
    """A divergence-free field of the plane or of space, turning about the middle."""
    out = [-(x[1] - 0.5), x[0] - 0.5]
    return out


def manufactured(x: Column) -> tuple[list[Column], Column]:
    """A divergence-free velocity, quadratic in the plane, and a linear pressure: what the stencils reproduce to rounding."""
    return [x[0] * x[0] + x[1], -2.0 * x[0] * x[1] + x[0]], x[0] + 2.0 * x[1] - 1.5


def velocity_field(nodes: DataFrame, field: Callable[[Column], list[Column]]) -> DataFrame:
    """(idx, axis, v) at nodes(id, x)."""
    each = nodes.select(F.col("id").alias("idx"), F.posexplode(F.array(*field(F.col("x")))).alias("axis", "v"))
    return each


def stencils(velocity: DataFrame, pressure: DataFrame, degree: int = 2, k: int = 3) -> dict[str, DataFrame]:
    """(op, node, ord, nbr, w): Laplacian and derivatives over velocity nodes (`u`), pressure derivatives at velocity nodes (`grad`), and
    velocity derivatives at pressure nodes (`div`), each over its own nearest nodes."""
    size = SUPPORTS[degree] if degree else 10
    dim = len(velocity.first()["x"])
    first = [f"d{i}" for i in range(dim)]

    def of(queries: DataFrame, points: DataFrame, ops: list[str]) -> DataFrame:
        near = sp.knn(queries.select("id", "x"), points.select("id", "x"), size)
        one = near.select("id", "ord", "nbr").join(points.select(F.col("id").alias("nbr"), F.col("x").alias("y")), "nbr")
        listed = one.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", "nbr", "y"))).alias("s")).join(queries.select("id", "x"), "id")
        each = [approx.operator(o) for o in ops]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):  # a batch as Python objects is far larger than its columns
                    out = []
                    for r in b.slice(at, ROWS).to_pylist():
                        w = approx.rbf_weights(np.array([p["y"] for p in r["s"]], float), np.asarray(r["x"], float), each, degree, k)
                        for op, row in zip(ops, w, strict=True):
                            out += [(op, r["id"], p["ord"], p["nbr"], float(v)) for p, v in zip(r["s"], row, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["op", "node", "ord", "nbr", "w"])

        return listed.mapInArrow(run, "op string, node long, ord int, nbr long, w double")

    return {"u": of(velocity, velocity, ["lap", *first]), "grad": of(velocity, pressure, first), "div": of(pressure, velocity, first)}


def assemble(velocity: DataFrame, pressure: DataFrame, weights: dict[str, DataFrame], convection: DataFrame, viscosity: float, n_u: int, n_p: int, constraint: str = "average") -> DataFrame:
    """(row, col, val) of -viscosity lap u + convection . grad u + grad p on inner nodes, u on the boundary, div u at pressure nodes, and a
    row that fixes the pressure: its `average`, or its value at the first node (`set`); the constraint's unknown is the last one."""
    dim = len(velocity.first()["x"])
    inner = velocity.filter("type > 0").select(F.col("id").alias("row"))
    momentum = pde.convection_diffusion(weights["u"], convection, viscosity, dim).join(inner, "row", "left_semi")
    boundary = velocity.filter("type < 0")
    out = None
    for d in range(dim):
        grad = approx._operator_entries(weights["grad"], f"d{d}").join(inner, "row", "left_semi")
        div = approx._operator_entries(weights["div"], f"d{d}")
        blocks = [
            approx.block_rows(momentum, d, d, n_u),
            approx.component_row(boundary, d, d, n_u),
            grad.select((F.col("row") + d * n_u).alias("row"), (F.col("col") + dim * n_u).alias("col"), "val"),
            div.select((F.col("row") + dim * n_u).alias("row"), (F.col("col") + d * n_u).alias("col"), "val"),
        ]
        for b in blocks:
            out = b if out is None else out.unionByName(b)
    last = dim * n_u + n_p
    fixed = pressure.select(F.lit(last).cast("long").alias("row"), (F.col("id") + dim * n_u).alias("col"), F.lit(1.0 / n_p).alias("val"))
    if constraint == "set":
        fixed = fixed.filter(F.col("col") == dim * n_u).withColumn("val", F.lit(1.0))
    # The constraint's multiplier takes up what the equations of mass can't meet together.
    multiplier = pressure.select((F.col("id") + dim * n_u).alias("row"), F.lit(last).cast("long").alias("col"), F.lit(1.0).alias("val"))
    return out.unionByName(fixed).unionByName(multiplier)


def without_known(a: DataFrame, rhs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The system without the unknowns known(idx, v): their columns go to the right side, their rows go."""
    from .linalg import eliminate, rhs_correction

    return eliminate(a, known.select("idx")), rhs_correction(a, rhs, known)


def rightmost_eigenvalue(a: solvers.Apply, n: int, **options) -> float:
    """The greatest real part among the eigenvalues of a discretized operator: above 0, steps in time grow."""
    values, _ = solvers.arnoldi(a, n, 1, rule="largest_real", **options)
    return float(np.real(values[0]))


def growth_exponent(spacings: np.ndarray, values: np.ndarray) -> float:
    """The q of values ~ spacing^-q, by least squares of the logarithms."""
    slope = np.polyfit(np.log(spacings), np.log(values), 1)[0]
    return float(-slope)
