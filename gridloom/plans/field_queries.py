"""Queries over fields on nodes: stencils, operators, shapes, time steps and meshes, whose values are known in closed form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mathx
from ..operators import approx, oseen, pde, shapes
from ..operators import cluster as cl
from ..operators import domains as dm
from ..operators import graph as gr
from ..operators import linalg as la
from ..operators import solvers as so
from ..operators import spatial as sp
from ..session import table
from .domain_queries import _FINE, _fine
from .graph_queries import _WITH, edges
from .part_nodes import EDGE, GRID
from .part_nodes import nodes as nodes_of
from .spatial_queries import low

def _weights(s, d, ops, k: int = 12, method: str = "rbf"):
    nodes = nodes_of(s, d).cache()
    return nodes, pde.weights(sp.knn(nodes, nodes, k), nodes, ops, method=method)


def _field(nodes: DataFrame, value) -> DataFrame:
    return nodes.select(F.col("id").alias("idx"), value(F.col("x")).alias("v"))


def _wls(s, d):
    nodes, w = _weights(s, d, ["lap"], 16, "wls")
    return pde.apply(w, "lap", _field(nodes, lambda x: x[0] * x[0] + 3 * x[1] * x[1])).select("idx", F.round("v", 3).alias("v"))


def _gradient(s, d):
    nodes, w = _weights(s, d, ["d0", "d1"])
    return pde.gradient(w, _field(nodes, lambda x: x[0] * x[0] + x[0] * x[1]), 2).select("idx", "axis", (F.round("v", 4) + 0.0).alias("v"))


def _vector(nodes: DataFrame, *values) -> DataFrame:
    return nodes.select(F.col("id").alias("idx"), F.posexplode(F.array(*[v(F.col("x")) for v in values])).alias("axis", "v"))


def _divergence(s, d):
    nodes, w = _weights(s, d, ["d0", "d1"])
    return pde.divergence(w, _vector(nodes, lambda x: x[0] * x[0], lambda x: x[0] * x[1])).select("idx", (F.round("v", 4) + 0.0).alias("v"))


def _curl(s, d):
    """Of (-y, x, z) at the suppliers, scattered over a box: (0, 0, 2)."""
    nodes = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), _scattered())
    w = pde.weights(sp.knn(nodes, nodes, 27), nodes, ["d0", "d1", "d2"], degree=1)
    f = _vector(nodes, lambda x: -x[1], lambda x: x[0], lambda x: x[2])
    return pde.curl(w, f).select("idx", "axis", (F.round("v", 6) + 0.0).alias("v"))


def _neumann(s, d):
    nodes, w = _weights(s, d, ["d0", "d1"])
    return la.spmv(pde.neumann(w, nodes), _field(nodes, lambda x: x[0] + 2 * x[1])).select("idx", F.round("v", 6).alias("v"))


def _convection(s, d):
    """-0.1 lap u + (1, 2) . grad u of u = x^2 + y: -0.2 + 2 x + 2."""
    nodes, w = _weights(s, d, ["lap", "d0", "d1"])
    velocity = _vector(nodes, lambda x: F.lit(1.0), lambda x: F.lit(2.0))
    return la.spmv(pde.convection_diffusion(w, velocity, 0.1, 2), _field(nodes, lambda x: x[0] * x[0] + x[1])).select("idx", F.round("v", 4).alias("v"))


def _hyperviscosity(s, d):
    """-0.5 h^4 times the Laplacian of the Laplacian of x^4 + x y: -12 h^4, as stencils with quartic monomials give it."""
    nodes = nodes_of(s, d).cache()
    values = approx.fine_values(nodes, lambda x: x[0] ** 4 + x[0] * x[1])
    return pde.hyperviscous(sp.knn(nodes, nodes, 40), values, 2, 0.5, degree=4, k=5).select("idx", F.round("v", 1).alias("v"))


def _steps(method: str, order: float):
    def run(s, d):
        start = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array((F.col("c_nationkey") + 1).cast("double")).alias("y"))
        return pde.integrate_series(start, lambda t, y: -y, 1.0, 400, method).select("id", F.round(F.col("y")[0], 4).alias("y"))

    return run


_DECAY = "SELECT c_custkey AS id, round((c_nationkey + 1) * exp(-1.0::DOUBLE), 4) AS y FROM customer"


def _tri(s, n: int = 6):
    return pde.unit_square_mesh(s, n)


#: A cube of side 2 as triangles that look outward.
_CUBE = [[0, 2, 1], [0, 3, 2], [4, 5, 6], [4, 6, 7], [0, 1, 5], [0, 5, 4], [2, 3, 7], [2, 7, 6], [1, 2, 6], [1, 6, 5], [0, 4, 7], [0, 7, 3]]


_AT = [(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0), (0, 0, 2), (2, 0, 2), (2, 2, 2), (0, 2, 2)]


def cube(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    vertices = s.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(_AT)], "id long, x array<double>")
    return vertices, s.createDataFrame([(i, v) for i, v in enumerate(_CUBE)], "id long, v array<long>")


def cubes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A cube for each supplier, side 1 to 3 by nation, in a row along the first axis, 8 apart."""
    k, size = F.col("s_suppkey"), F.col("s_nationkey") % 3 + 1
    suppliers = table(s, d, "supplier")
    corner = F.array(*[F.array(*[F.lit(float(c) / 2) for c in x]) for x in _AT])
    vertices = suppliers.select(k.alias("k"), size.alias("size"), F.posexplode(corner).alias("i", "c"))
    faces = suppliers.select(k.alias("k"), F.posexplode(F.array(*[F.array(*[F.lit(v).cast("long") for v in f]) for f in _CUBE])).alias("i", "v"))
    x = F.array(F.col("k") * 8 + F.col("c")[0] * F.col("size"), F.col("c")[1] * F.col("size"), F.col("c")[2] * F.col("size"))
    return vertices.select((F.col("k") * 8 + F.col("i")).alias("id"), x.alias("x")), faces.select((F.col("k") * 12 + F.col("i")).alias("id"), F.transform("v", lambda v: F.col("k") * 8 + v).alias("v"))


#: The suppliers' cubes: number k and side.
_CUBES = "(SELECT s_suppkey AS k, s_nationkey % 3 + 1 AS size FROM supplier)"


def _each(rows: DataFrame, work, schema: str) -> DataFrame:
    """The rows that work(row) lists for each row: small numeric kernels, a batch of rows at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([o for r in f.itertuples(index=False) for o in work(r)], columns=names)

    return rows.mapInPandas(run, schema)


def _nations(s, d) -> DataFrame:
    return table(s, d, "nation").select("n_nationkey", "n_regionkey")


def _clients(s, d) -> DataFrame:
    """(nation, n): how many customers each nation has."""
    return table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


_CLIENTS = "(SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey)"


def _tridiagonal(r):
    """Eigenvalues of the second difference of as many points as a nation has customers."""
    return [(r.nation, i, round(float(v), 8)) for i, v in enumerate(so.tridiagonal_eigen(np.full(r.n, 2.0), np.full(r.n - 1, -1.0))[0])]


def _growth(r):
    """A rotation that grows by g: the greatest real part, and the exponent of values that fall fourfold by halves."""
    g = (r.n_nationkey + 1) / 8
    a = np.array([[g, -3.0, 0], [3.0, g, 0], [0, 0, -1.0]])
    return [(r.n_nationkey, round(oseen.rightmost_eigenvalue(lambda x: a @ x, 3), 6), round(oseen.growth_exponent(np.array([0.1, 0.05, 0.025]), g * np.array([3.0, 12.0, 48.0])), 6))]


def _inside_cube(s, d):
    """The suppliers, scattered over a box of side 4, that are inside the cube of side 2."""
    vertices, faces = cube(s)
    points = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), _scattered())
    return shapes.in_polyhedron(points, faces, vertices, 0.5)


def _scattered():
    k = F.col("s_suppkey")
    return F.array((k * 37 % 101) / 25.0 + 0.001, (k * 53 % 103) / 26.0 + 0.0013, (k * 71 % 107) / 27.0 + 0.0017).alias("x")


_SCATTERED = "(SELECT s_suppkey AS id, (s_suppkey * 37 % 101) / 25.0::DOUBLE + 0.001 AS x, (s_suppkey * 53 % 103) / 26.0::DOUBLE + 0.0013 AS y, (s_suppkey * 71 % 107) / 27.0::DOUBLE + 0.0017 AS z FROM supplier)"


def _approximated(method: str):
    """x^2 + x y and its first derivative at scattered points, from a grid's values."""

    def run(s, d):
        nodes = nodes_of(s, d)
        values = nodes.select("id", "x", (F.col("x")[0] * F.col("x")[0] + F.col("x")[0] * F.col("x")[1]).alias("v"))
        queries = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array((F.col("s_suppkey") * 37 % 101) / 101.0, (F.col("s_suppkey") * 53 % 103) / 103.0).alias("x"))
        ops = {n: approx.operator(n) for n in ("value", "d0")}
        found = approx.approximate(queries, sp.knn(queries, nodes.select("id", "x"), 14), values, ops, method=method)
        return found.select("id", "op", F.round("v", 6).alias("v"), (F.round("residual", 6) + 0.0).alias("residual"))

    return run


_APPROX = """SELECT s_suppkey AS id, op, round(CASE op WHEN 'value' THEN x * x + x * y ELSE 2 * x + y END, 6) AS v, 0.0::DOUBLE AS residual
  FROM (SELECT s_suppkey, (s_suppkey * 37 % 101) / 101.0::DOUBLE AS x, (s_suppkey * 53 % 103) / 103.0::DOUBLE AS y FROM supplier), (VALUES ('value'), ('d0')) o(op)"""


def _user_operator(s, d):
    """The Laplacian of the Laplacian, given by its two parts, of x^4 + x^2 y^2: 24 + 8."""
    nodes = nodes_of(s, d).cache()
    values = approx.fine_values(nodes, lambda x: x[0] ** 4 + x[0] ** 2 * x[1] ** 2)
    found = approx.approximate(nodes, sp.knn(nodes, nodes, 40), values, {"lap2": approx.bilaplacian(2)}, degree=4, k=5)
    return found.select("id", F.round("v", 1).alias("v"))


def _grad_div(s, d):
    """grad div (x^2, x y): (2, 0) + (1, 0)... by rows of a vector equation: d/dx (2 x + x) = 3, d/dy (3 x) = 0."""
    nodes, w = _weights(s, d, ["d00", "d01", "d11"])
    n = nodes.count()
    u = _vector(nodes, lambda x: x[0] * x[0], lambda x: x[0] * x[1]).select((F.col("idx") + F.col("axis") * n).alias("idx"), "v")
    return la.spmv(approx.grad_div(w, 2, n), u).select("idx", (F.round("v", 4) + 0.0).alias("v"))


def _vector_laplacian(s, d):
    nodes, w = _weights(s, d, ["lap"])
    n = nodes.count()
    lap = w.select(F.col("node").alias("row"), F.col("nbr").alias("col"), F.col("w").alias("val"))
    u = _vector(nodes, lambda x: x[0] * x[0], lambda x: 2 * x[1] * x[1]).select((F.col("idx") + F.col("axis") * n).alias("idx"), "v")
    return la.spmv(approx.vector_laplacian(lap, 2, n, 0.5), u).select("idx", F.round("v", 4).alias("v"))


def _traction(s, d):
    """Of the displacement (x, 0) with lam = 1, mu = 2: stress 5 along the first axis and 1 along the second."""
    nodes, w = _weights(s, d, ["d0", "d1"])
    n = nodes.count()
    u = _vector(nodes, lambda x: x[0], lambda x: F.lit(0.0)).select((F.col("idx") + F.col("axis") * n).alias("idx"), "v")
    return la.spmv(approx.traction(w, nodes, 2, n, 1.0, 2.0), u).select("idx", (F.round("v", 5) + 0.0).alias("v"))


def _wide(s, d) -> int:
    """Velocity nodes along a side of the box: they grow with the suppliers."""
    return 4 + math.isqrt(table(s, d, "supplier").count())


def oseen_system(s: SparkSession, n: int, constraint: str = "average"):
    velocity, pressure = oseen.node_sets(s, [0.0, 0.0], [1.0, 1.0], [n, n])
    velocity, pressure = velocity.cache(), pressure.cache()
    w = {k: v.cache() for k, v in oseen.stencils(velocity, pressure).items()}
    convection = oseen.velocity_field(velocity, oseen.swirl)
    n_u, n_p = n * n, (n - 1) * (n - 1)
    return velocity, pressure, oseen.assemble(velocity, pressure, w, convection, 0.5, n_u, n_p, constraint), n_u, n_p


def _oseen_solution(s: SparkSession, velocity, pressure, n_u, n_p) -> np.ndarray:
    u, p = oseen.manufactured(F.col("x"))
    x = np.zeros(2 * n_u + n_p + 1)
    for r in velocity.select("id", u[0].alias("a"), u[1].alias("b")).collect():
        x[r["id"]], x[n_u + r["id"]] = r["a"], r["b"]
    for r in pressure.select("id", p.alias("p")).collect():
        x[2 * n_u + r["id"]] = r["p"]
    return x


def _oseen(constraint: str):
    """The assembled Oseen system with a quadratic velocity and a linear pressure: solved for both."""

    def run(s, d):
        velocity, pressure, a, n_u, n_p = oseen_system(s, _wide(s, d), constraint)
        exact = _oseen_solution(s, velocity, pressure, n_u, n_p)
        n = 2 * n_u + n_p + 1
        dense = np.zeros((n, n))
        for r in a.groupBy("row", "col").agg(F.sum("val").alias("val")).collect():
            dense[r["row"], r["col"]] = r["val"]
        x = np.linalg.lstsq(dense, dense @ exact, rcond=None)[0]
        rows = [("u", i, float(round(x[i], 4)) + 0.0) for i in range(2 * n_u)] + [("p", i, float(round(x[2 * n_u + i], 3)) + 0.0) for i in range(n_p)]
        return s.createDataFrame(rows, "part string, idx long, v double")

    return run


_WIDE = "w AS (SELECT 4 + CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM supplier)"
_OSEEN = f"""WITH {_WIDE}, g AS (SELECT i * w + j AS idx, w, i::DOUBLE / (w - 1) AS x, j::DOUBLE / (w - 1) AS y FROM w, range((SELECT w FROM w)) a(i), range((SELECT w FROM w)) b(j)),
  c AS (SELECT i * (w - 1) + j AS idx, (i + 0.5::DOUBLE) / (w - 1) AS x, (j + 0.5::DOUBLE) / (w - 1) AS y FROM w, range((SELECT w - 1 FROM w)) a(i), range((SELECT w - 1 FROM w)) b(j))
  SELECT 'u' AS part, idx, round(x * x + y, 4) + 0.0 AS v FROM g UNION ALL SELECT 'u', idx + w * w, round(-2 * x * y + x, 4) + 0.0 FROM g UNION ALL SELECT 'p', idx, round(x + 2 * y - 1.5, 3) + 0.0 FROM c"""


def _oseen_residual(s, d):
    """The rows of momentum and mass times the manufactured solution: its right side, at every node."""
    velocity, pressure, a, n_u, n_p = oseen_system(s, _wide(s, d))
    u, p = oseen.manufactured(F.col("x"))
    each = [velocity.select((F.col("id") + axis * n_u).alias("idx"), u[axis].alias("v")) for axis in (0, 1)]
    x = each[0].unionByName(each[1]).unionByName(pressure.select((F.col("id") + 2 * n_u).alias("idx"), p.alias("v")))  # the constraint's unknown is 0
    inner = velocity.filter("type > 0").select(F.col("id").alias("idx"))
    return la.spmv(a, x).join(inner, "idx", "left_semi").select("idx", (F.round("v", 4) + 0.0).alias("v"))


def _relaxed(s, d):
    """One push of the part nodes by their four nearest; those that would leave the square stay."""
    nodes = nodes_of(s, d).select("id", "x", "type").cache()
    moved = dm.relax(nodes, 4, 1, 0.1, pde.in_box(F.col("x"), [0.0, 0.0], [1.0, 1.0]))
    return moved.select("id", F.round(F.col("x")[0], 6).alias("x"), F.round(F.col("x")[1], 6).alias("y"))


def _refined(s, d):
    """Middles of the links of the lattice's inner nodes in a stripe to their four nearest."""
    nodes = nodes_of(s, d).cache()
    found = dm.refine(nodes, (F.col("x")[0] > 0.2) & (F.col("x")[0] < 0.4) & (F.col("type") > 0), 4, 0.4, 1_000_000)
    return found.select(F.round(F.col("x")[0], 6).alias("x"), F.round(F.col("x")[1], 6).alias("y"))


_TREE = ["x", "y"]


def _tree(s, d, leaf: int = 20):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return cl.tree(cl.bisect(p, _TREE, leaf, 30), _TREE)


def _typed(s, d) -> DataFrame:
    """Nations as clusters of types 0, 1, 2 in turn, each associated with the one that mirrors it."""
    last = table(s, d, "nation").count() - 1
    k = F.col("n_nationkey").cast("long")
    return table(s, d, "nation").select(k.alias("node"), (k % 3).alias("type"), (last - k).alias("associated"))


_TYPED = "(SELECT n_nationkey::BIGINT AS node, n_nationkey % 3 AS type, (SELECT count(*) - 1 FROM nation) - n_nationkey AS associated FROM nation)"


def _paired(s, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("id"), (k + 1_000_000_000).alias("ghost"), F.col("s_nationkey").alias("cluster"), (F.col("s_nationkey") + (F.col("s_acctbal") < 3000).cast("int")).alias("own"))


def _on_arc(r):
    x, y = mathx.nurbs((r.c_custkey % 997) / 1000, [0, 0, 0, 1, 1, 1], [[1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], [1.0, 0.5**0.5, 1.0], 2)
    return [(r.c_custkey, round(x * x + y * y, 9), round(y / x, 6))]


def _exponents(r):
    dim, degree = 1 + r.n_nationkey % 3, r.n_nationkey // 3 % 4
    return [(dim, degree, ",".join(map(str, e))) for e in pde.monomials(dim, degree)]


def _partitioned(s, d):
    e = edges(s, d)
    v = e.select(F.col("src").alias("id")).distinct()
    parts = gr.partition(e, v, 2)
    sub = gr.subdomains(e, parts)
    inner = sub.filter("NOT separator").select("id", "part")
    return gr.edge_cut(gr.induced(e, inner.select("id")), inner).select("cut").join(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") - F.min("n")).alias("spread"), F.sum("n").alias("vertices")))


QUERIES = {
    "wls_laplacian": (_wls, f"SELECT idx, 8.0::DOUBLE AS v FROM {GRID}"),
    "explicit_gradient": (_gradient, f"SELECT idx, axis::INT AS axis, round(CASE axis WHEN 0 THEN 2 * x + y ELSE x END, 4) + 0.0 AS v FROM {GRID}, range(2) a(axis)"),
    "explicit_divergence": (_divergence, f"SELECT idx, round(3 * x, 4) + 0.0 AS v FROM {GRID}"),
    "explicit_curl": (_curl, "SELECT s_suppkey AS idx, axis::INT AS axis, CASE axis WHEN 2 THEN 2.0 ELSE 0.0 END::DOUBLE AS v FROM supplier, range(3) a(axis)"),
    "neumann_rows": (_neumann, f"SELECT idx, CASE type WHEN -1 THEN -1.0 WHEN -2 THEN 1.0 WHEN -3 THEN -2.0 ELSE 2.0 END::DOUBLE AS v FROM {GRID} WHERE {EDGE}"),
    "convection_diffusion": (_convection, f"SELECT idx, round(1.8 + 2 * x, 4) AS v FROM {GRID}"),
    "hyperviscosity": (_hyperviscosity, "SELECT p_partkey AS idx, -12.0::DOUBLE AS v FROM part"),
    "adams_bashforth": (_steps("ab", 4), _DECAY),
    "runge_kutta_38": (_steps("rk38", 4), _DECAY),
    "runge_kutta_fehlberg": (_steps("fehlberg5", 5), _DECAY),
    "node_types": (lambda s, d: nodes_of(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("normal").alias("normals")), f"SELECT type, count(*) AS n, count(*) FILTER (type < 0) AS normals FROM {GRID} GROUP BY type"),
    "switch_boundary": (
        lambda s, d: shapes.to_interior(shapes.to_boundary(nodes_of(s, d), F.col("id") % 97 == 84, -9, F.array(F.lit(1.0), F.lit(0.0))), F.col("type") == -3).select("id", "type", F.col("normal").isNotNull().alias("has_normal")),
        f"SELECT idx AS id, CASE WHEN idx % 97 = 84 THEN -9 WHEN type = -3 THEN 1 ELSE type END::INT AS type, idx % 97 = 84 OR type IN (-1, -2, -4) AS has_normal FROM {GRID}",
    ),
    "shape_containment": (
        lambda s, d: nodes_of(s, d).filter(pde.in_polygon(F.col("x"), [(0.01, 0.02), (0.91, 0.02), (0.01, 0.92)])).select("id"),
        f"SELECT idx AS id FROM {GRID} WHERE x > 0.01 AND y > 0.02 AND (x - 0.01) + (y - 0.02) < 0.9",
    ),
    "polyhedron_containment": (_inside_cube, f"SELECT id FROM {_SCATTERED} WHERE x < 2 AND y < 2 AND z < 2"),
    "polyhedron_moments": (
        lambda s, d: dm.polyhedron_volume_moments(*cubes(s, d)).select(*[F.round(c, 4).alias(c) for c in ("volume", "m0", "m1", "m2")]),
        f"SELECT sum(size ** 3)::DOUBLE AS volume, sum(size ** 3 * (8 * k + size / 2.0::DOUBLE)) AS m0, sum(size ** 4 / 2.0::DOUBLE) AS m1, sum(size ** 4 / 2.0::DOUBLE) AS m2 FROM {_CUBES}",
    ),
    "face_normals": (
        lambda s, d: shapes.face_normals(cubes(s, d)[1], cubes(s, d)[0]).select("id", *[(F.round(F.col("normal")[i], 9) + 0.0).alias(f"n{i}") for i in range(3)], F.round("area", 9).alias("area")),
        f"SELECT k * 12 + i AS id, CASE WHEN i IN (8, 9) THEN 1.0 WHEN i IN (10, 11) THEN -1.0 ELSE 0.0 END::DOUBLE AS n0, CASE WHEN i IN (4, 5) THEN -1.0 WHEN i IN (6, 7) THEN 1.0 ELSE 0.0 END::DOUBLE AS n1, CASE WHEN i < 2 THEN -1.0 WHEN i < 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS n2, size * size / 2.0::DOUBLE AS area FROM {_CUBES}, range(12) t(i)",
    ),
    "discretize_line": (
        lambda s, d: shapes.line(s, [0.0, 0.0], [3.0, 4.0], 5.0 / table(s, d, "part").count()).select("id", F.round(F.col("x")[0], 9).alias("x"), F.round(F.col("normal")[0], 9).alias("nx")),
        "SELECT i AS id, round(3.0::DOUBLE * i / (SELECT count(*) FROM part), 9) AS x, 0.8::DOUBLE AS nx FROM range((SELECT count(*) + 1 FROM part)) t(i)",
    ),
    "discretize_line_by_density": (
        lambda s, d: _each(_nations(s, d), lambda r: [(r.n_nationkey, i, round(float(x[0]), 9)) for i, x in enumerate(shapes.line_by_density([0.0], [2.0 ** (1 + r.n_nationkey % 6) - 1], lambda x: 1.0 + x[0]))], "nation int, id long, x double"),
        "SELECT n_nationkey AS nation, i AS id, (2 ** i - 1)::DOUBLE AS x FROM nation, range(7) t(i) WHERE i <= 1 + n_nationkey % 6",
    ),
    "discretize_circle": (
        lambda s, d: shapes.circle(s, [1.0, 2.0], 2.0, 4 * math.pi / table(s, d, "part").count()).select("id", F.round(F.col("x")[0], 6).alias("x"), F.round(F.col("x")[1], 6).alias("y")),
        "SELECT p_partkey AS id, round(1 + 2 * cos(p_partkey * (2 * pi() / n)), 6) AS x, round(2 + 2 * sin(p_partkey * (2 * pi() / n)), 6) AS y FROM part, (SELECT count(*) AS n FROM part)",
    ),
    "discretize_sphere": (
        lambda s, d: shapes.sphere(s, [0.0, 0.0, 0.0], 1.0, math.pi / (table(s, d, "supplier").count() + 1)).select((F.abs(F.col("x")[0] ** 2 + F.col("x")[1] ** 2 + F.col("x")[2] ** 2 - 1) < 1e-12).alias("on"), F.col("x")[2].alias("ring")).groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("on")).select((F.round("ring", 6) + 0.0).alias("z"), "n", "on"),
        "SELECT round(cos(i * pi() / r), 6) + 0.0 AS z, greatest(1, ceil(2 * pi() * sin(i * pi() / r) / (pi() / r) - 1e-9))::BIGINT AS n, true AS on FROM (SELECT count(*) + 1 AS r FROM supplier), range((SELECT count(*) + 2 FROM supplier)) t(i)",
    ),
    "discretize_mesh": (
        lambda s, d: shapes.mesh_nodes(cubes(s, d)[1], cubes(s, d)[0], 0.5).groupBy("face").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x")[1] + F.col("x")[2]), 6).alias("total")),
        f"""WITH c AS (SELECT k, size, ceil(size * sqrt(2.0::DOUBLE) / 0.5 - 1e-9)::BIGINT AS n FROM {_CUBES}),
            v AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 0, 1), (5, 0, 1), (6, 1, 1), (7, 1, 1)) t(i, y, z)),
            f AS (SELECT * FROM (VALUES {", ".join(f"({i}, {', '.join(map(str, x))})" for i, x in enumerate(_CUBE))}) t(i, a, b, c)),
            p AS (SELECT f.i, a.y + a.z AS a, b.y + b.z AS b, c.y + c.z AS c FROM f JOIN v a ON a.i = f.a JOIN v b ON b.i = f.b JOIN v c ON c.i = f.c)
            SELECT k * 12 + p.i AS face, count(*) AS n, round(sum(size * (p.a + (p.b - p.a) * g / n::DOUBLE + (p.c - p.a) * h / n::DOUBLE)), 6) AS total FROM c, p, range(1, 10) r(g), range(1, 10) s(h) WHERE g + h < n GROUP BY c.k, p.i""",
    ),
    "discretize_mesh_edges": (
        lambda s, d: shapes.mesh_edge_nodes(cubes(s, d)[1], cubes(s, d)[0], 0.5).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy(F.floor(F.col("a") / 8).alias("cube"), "n").agg(F.count(F.lit(1)).alias("edges")),
        f"SELECT k AS cube, CAST(ceil(size * f / 0.5 - 1e-9) - 1 AS BIGINT) AS n, sum(e)::BIGINT AS edges FROM {_CUBES}, (VALUES (1.0::DOUBLE, 12), (sqrt(2.0::DOUBLE), 6)) t(f, e) GROUP BY 1, 2",
    ),
    "density_fill": (
        lambda s, d: shapes.density_fill(s, F.lit(True), [0.0, 0.0], [1.0, 1.0], F.when(F.col("x")[0] < 0.5, _fine(s, d)).otherwise(2 * _fine(s, d)), _fine(s, d)).select("id"),
        f"SELECT i * (n + 1) + j AS id FROM {_FINE}, range((SELECT n + 1 FROM {_FINE})) a(i), range((SELECT n + 1 FROM {_FINE})) b(j) WHERE 2 * i < n OR (i % 2 = 0 AND j % 2 = 0)",
    ),
    "domain_plugin": (lambda s, d: shapes.plugged(nodes_of(s, d), lambda n: n.filter("type > 0"), lambda n: n.select("id")), f"SELECT idx AS id FROM {GRID} WHERE NOT {EDGE}"),
    "rbf_approximant": (_approximated("rbf"), _APPROX),
    "wls_approximant": (_approximated("wls"), _APPROX),
    "user_operator": (_user_operator, "SELECT p_partkey AS id, 32.0::DOUBLE AS v FROM part"),
    "implicit_grad_div": (_grad_div, "WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS idx, 3.0::DOUBLE AS v FROM part UNION ALL SELECT p_partkey + n, 0.0 FROM part, n"),
    "implicit_vector_laplacian": (_vector_laplacian, "WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey AS idx, 1.0::DOUBLE AS v FROM part UNION ALL SELECT p_partkey + n, 2.0 FROM part, n"),
    "implicit_traction": (
        _traction,
        f"""WITH g AS (SELECT idx, CASE type WHEN -1 THEN -1.0 WHEN -2 THEN 1.0 ELSE 0.0 END::DOUBLE AS n0, CASE type WHEN -3 THEN -1.0 WHEN -4 THEN 1.0 ELSE 0.0 END::DOUBLE AS n1 FROM {GRID} WHERE {EDGE})
            SELECT idx, 5 * n0 + 0.0 AS v FROM g UNION ALL SELECT idx + (SELECT count(*) FROM part), n1 + 0.0 FROM g""",
    ),
    "oseen_average_pressure": (_oseen("average"), _OSEEN),
    "oseen_set_pressure": (_oseen("set"), _OSEEN),
    "oseen_momentum": (
        _oseen_residual,
        f"""WITH {_WIDE} SELECT i * w + j AS idx, round(-0.5 * 2 + -(y - 0.5) * 2 * x + (x - 0.5) * 1 + 1, 4) + 0.0 AS v FROM (SELECT i, j, w, i::DOUBLE / (w - 1) AS x, j::DOUBLE / (w - 1) AS y FROM w, range((SELECT w FROM w)) a(i), range((SELECT w FROM w)) b(j)) WHERE i NOT IN (0, w - 1) AND j NOT IN (0, w - 1)""",
    ),
    "rightmost_eigenvalue": (lambda s, d: _each(_nations(s, d), _growth, "nation int, real double, exponent double"), "SELECT n_nationkey AS nation, (n_nationkey + 1) / 8.0::DOUBLE AS real, 2.0::DOUBLE AS exponent FROM nation"),
    "tridiagonal_eigen": (
        lambda s, d: _each(_clients(s, d), _tridiagonal, "nation int, idx long, eigenvalue double"),
        f"SELECT nation, i AS idx, round(2 - 2 * cos(pi() * (i + 1) / (n + 1)), 8) AS eigenvalue FROM {_CLIENTS}, range((SELECT max(n) FROM {_CLIENTS})) t(i) WHERE i < n",
    ),
    "condition_estimate": (
        lambda s, d: _each(_clients(s, d), lambda r: [(r.nation, round(so.condition_by_parts(np.arange(r.n), np.arange(r.n), np.arange(1.0, r.n + 1), r.n), 6))], "nation int, condition double"),
        f"SELECT nation, n::DOUBLE AS condition FROM {_CLIENTS}",
    ),
    "relax_nodes": (
        _relaxed,
        f"""WITH g AS (SELECT * FROM {GRID}), k AS (SELECT a.idx, a.x, a.y, b.idx AS nbr, a.x - b.x AS dx, a.y - b.y AS dy, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM g a, g b WHERE a.type > 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d2, nbr) AS r FROM k),
            f AS (SELECT idx, sum(dx / (d2 * d2 + 1e-30)) AS fx, sum(dy / (d2 * d2 + 1e-30)) AS fy, sqrt(min(d2)) AS reach FROM r WHERE r <= 5 AND nbr <> idx GROUP BY idx),
            n AS (SELECT idx, g.x, g.y, g.x + fx / (sqrt(fx * fx + fy * fy) + 1e-30) * reach * 0.1 AS nx, g.y + fy / (sqrt(fx * fx + fy * fy) + 1e-30) * reach * 0.1 AS ny FROM g LEFT JOIN f USING (idx))
            SELECT idx AS id, round(CASE WHEN nx > 0 AND nx < 1 AND ny > 0 AND ny < 1 THEN nx ELSE x END, 6) AS x, round(CASE WHEN nx > 0 AND nx < 1 AND ny > 0 AND ny < 1 THEN ny ELSE y END, 6) AS y FROM n""",
    ),
    "refine_nodes": (
        _refined,
        f"""WITH g AS (SELECT * FROM {GRID}), k AS (SELECT a.idx, b.idx AS nbr, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM g a, g b WHERE a.type > 0 AND a.x > 0.2 AND a.x < 0.4),
            r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d2, nbr) AS r FROM k),
            l AS (SELECT DISTINCT least(idx, nbr) AS a, greatest(idx, nbr) AS b, d2 FROM r WHERE r <= 5 AND nbr <> idx),
            m AS (SELECT a, b, d2, (p.x + q.x) / 2 AS x, (p.y + q.y) / 2 AS y FROM l JOIN g p ON p.idx = a JOIN g q ON q.idx = b),
            n AS (SELECT m.a, m.b, m.d2, m.x, m.y, min((m.x - g.x) ** 2 + (m.y - g.y) ** 2) AS least FROM m, g GROUP BY ALL)
            SELECT round(x, 6) AS x, round(y, 6) AS y FROM n WHERE least >= 0.4 * 0.4 * d2 * 0.999999""",
    ),
    "tree_faults": (lambda s, d: cl.tree_faults(_tree(s, d)).unionByName(cl.tree_faults(cl.balanced(_tree(s, d), 12))).agg(F.count(F.lit(1)).alias("faults")), "SELECT 0::BIGINT AS faults"),
    "ghost_pairing": (
        # Ghosts of suppliers are in their nation's cluster, but those of suppliers with less than 3000 in the next one.
        lambda s, d: cl.pairing_faults(_paired(s, d).select("id", "cluster").unionByName(_paired(s, d).select(F.col("ghost").alias("id"), F.col("own").alias("cluster"))), _paired(s, d).select("id", "ghost")),
        "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 3000",
    ),
    "graph_partition": (_partitioned, f"WITH {_WITH} SELECT 0::BIGINT AS cut, CASE WHEN count(DISTINCT src) % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS spread, count(DISTINCT src) AS vertices FROM e"),
    "dissected_admissible": (
        lambda s, d: cl.pairs(_typed(s, d), _typed(s, d)).filter(cl.dissected_admissible(F.col("r_node") + F.col("c_node") == 9, True)).select("r_node", "c_node"),
        f"SELECT a.node AS r_node, b.node AS c_node FROM {_TYPED} a, {_TYPED} b WHERE NOT (a.type = 2 AND b.type = 2) AND ((a.type = 1 AND b.type = 1 AND a.node <> b.node) OR a.node + b.node = 9)",
    ),
    "coupled_admissible": (
        lambda s, d: cl.pairs(_typed(s, d), _typed(s, d)).filter(cl.coupled_admissible(F.lit(False))).select("r_node", "c_node"),
        f"SELECT a.node AS r_node, b.node AS c_node FROM {_TYPED} a, {_TYPED} b WHERE a.type = 1 AND b.type = 1 AND b.node <> a.associated",
    ),
    "bisection_root": (
        lambda s, d: _each(table(s, d, "part").select("p_partkey", "p_size"), lambda r: [(r.p_partkey, round(mathx.bisection(lambda x: x * x, 0.0, 60.0, float(r.p_size)), 8))], "id long, root double"),
        "SELECT p_partkey AS id, round(sqrt(p_size::DOUBLE), 8) AS root FROM part",
    ),
    "gauss_quadrature": (
        lambda s, d: _each(table(s, d, "part").select("p_partkey", "p_size"), lambda r: [(r.p_partkey, round(sum(w * x**4 for x, w in zip(*mathx.gauss_legendre(3 + r.p_partkey % 3, 0.0, float(r.p_size)), strict=True)), 4))], "id long, v double"),
        "SELECT p_partkey AS id, round(p_size::DOUBLE ** 5 / 5, 4) AS v FROM part",
    ),
    "nurbs_arc": (
        # A quarter of a circle: with t = k / 1000 the angle's tangent is known in closed form too.
        lambda s, d: _each(table(s, d, "customer").select("c_custkey"), _on_arc, "id long, r2 double, tangent double"),
        "SELECT c_custkey AS id, 1.0::DOUBLE AS r2, round((sqrt(2.0::DOUBLE) * t * (1 - t) + t * t) / ((1 - t) * (1 - t) + sqrt(2.0::DOUBLE) * t * (1 - t)), 6) AS tangent FROM (SELECT c_custkey, (c_custkey % 997) / 1000.0::DOUBLE AS t FROM customer)",
    ),
    "rotation": (
        lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id"), *[(F.round(c, 6) + 0.0).alias(n) for n, c in zip("xy", mathx.rotate2(F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("double"), float(np.pi / 2)), strict=True)]),
        "SELECT c_custkey AS id, -c_nationkey::DOUBLE + 0.0 AS x, c_custkey::DOUBLE AS y FROM customer",
    ),
    "monomials": (
        lambda s, d: _each(_nations(s, d), lambda r: [(r.n_nationkey, *e) for e in _exponents(r)], "nation int, dim long, degree long, exponents string"),
        """WITH n AS (SELECT n_nationkey AS nation, (1 + n_nationkey % 3)::BIGINT AS dim, (n_nationkey // 3 % 4)::BIGINT AS degree FROM nation)
           SELECT nation, dim, degree, CASE dim WHEN 1 THEN concat(i) WHEN 2 THEN concat(i, ',', j) ELSE concat(i, ',', j, ',', k) END AS exponents FROM n, range(4) a(i), range(4) b(j), range(4) c(k) WHERE i + j + k <= degree AND (dim > 1 OR j = 0) AND (dim > 2 OR k = 0)""",
    ),
    "bfs_clustering": (
        lambda s, d: gr.two_front_partition(edges(s, d), edges(s, d).select(F.col("src").alias("id")).distinct()).agg(F.count(F.lit(1)).alias("vertices"), F.count_distinct("side").alias("sides")),
        f"WITH {_WITH} SELECT count(DISTINCT src) AS vertices, 2::BIGINT AS sides FROM e",
    ),
}
