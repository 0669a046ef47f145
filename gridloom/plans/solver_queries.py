"""Queries over solvers, eigensolvers, discretization, low-rank blocks and scalar functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mathx
from ..operators import cluster as cl
from ..operators import krylov as kr
from ..operators import linalg as la
from ..operators import lowrank as lr
from ..operators import normal, pde
from ..operators import solvers as so
from ..operators import spatial as sp
from ..session import cut_lineage, table
from . import part_nodes
from .linalg_queries import _A, matrix, n_suppliers
from .part_nodes import GRID, TRIANGLES


def gram(s: SparkSession, d: str) -> DataFrame:
    """A^T A of parts by suppliers, scaled, with a shifted diagonal: symmetric and positive definite."""
    a = matrix(s, d)
    g = la.scale(la.spmm(a, a, a_transposed=True), 1e-4)
    return la.add(la.identity(s, n_suppliers(s, d), 0.2), g)


def gram_blocks(s: SparkSession, d: str) -> DataFrame:
    """The same matrix in square blocks, made from lineitem's rows as they are."""
    a = table(s, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("val"))
    return normal.product(a, n_suppliers(s, d), 1e-4, 0.2)


def _vector(s: SparkSession, v: np.ndarray, name: str = "v") -> DataFrame:
    return s.createDataFrame([(i, float(x)) for i, x in enumerate(v)], f"idx long, {name} double")


def _known(n: int) -> np.ndarray:
    return 1.0 + np.arange(n) % 7


_KNOWN = "SELECT s_suppkey AS idx, 1.0::DOUBLE + s_suppkey % 7 AS v FROM supplier"


def _solve(method):
    """The solution of A x = A x*, for a known x*; a solver that stops short of it is an error."""

    def run(s, d):
        a = so.BlockMap(gram_blocks(s, d), n_suppliers(s, d))
        b = a(_known(a.shape[0]))
        x = method(a, a.transposed, b)
        if np.linalg.norm(a(x) - b) > 1e-8 * np.linalg.norm(b):
            raise RuntimeError("the solver didn't converge")
        return _vector(s, np.round(x, 4) + 0.0)

    return run


def _distributed(method):
    """As _solve, with no vector on the driver."""

    def run(s, d):
        known = table(s, d, "supplier").select(F.col("s_suppkey").alias("idx"), (F.lit(1.0) + F.col("s_suppkey") % 7).alias("v"))
        g = kr.BlockMatrix(gram_blocks(s, d), n_suppliers(s, d), normal.BLOCK, packed=True)
        x, _ = method(g, g.product(known))
        return x.select("idx", (F.round("v", 4) + 0.0).alias("v"))

    return run


def _leading(s, d):
    """The leading singular value and vectors of lineitem's matrix A, by Lanczos on A^T A with distributed vectors: sigma, and the largest entry of |A^T A v - sigma^2 v| over sigma^2."""
    a = table(s, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("val"))
    n = n_suppliers(s, d)
    g = kr.BlockMatrix(normal.product(a, n), n, normal.BLOCK, packed=True)
    start = table(s, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.lit(1.0).alias("v"))
    values, pairs = kr.lanczos(g, start, 1)
    x = pairs.select("idx", "v")
    left = la.axpy(x, g.product(x), -float(values[0])).agg((F.max(F.abs("v")) / float(values[0]) <= 1e-9).alias("exact"))
    return left.select(F.lit(round(float(np.sqrt(values[0])), 3)).alias("sigma"), "exact")


def rotated(s: SparkSession, d: str) -> DataFrame:
    """A symmetric matrix whose eigenvalues are the suppliers' balances: pairs of them, turned by an angle."""
    v = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    pair = v.filter("k % 2 = 0").select("k", F.col("v").alias("a")).join(v.filter("k % 2 = 1").select((F.col("k") - 1).alias("k"), F.col("v").alias("b")), "k", "left")
    angle = F.lit(0.3) + (F.col("k") / 2) % 5 * 0.2
    co, si, k, a, b = F.cos(angle), F.sin(angle), F.col("k"), F.col("a"), F.col("b")
    alone = F.array(F.struct(k.alias("row"), k.alias("col"), a.alias("val")))
    entry = lambda i, j, x: F.struct((k + i).alias("row"), (k + j).alias("col"), x.alias("val"))
    both = F.array(entry(0, 0, co * co * a + si * si * b), entry(0, 1, co * si * (a - b)), entry(1, 0, co * si * (a - b)), entry(1, 1, si * si * a + co * co * b))
    return pair.select(F.explode(F.when(b.isNull(), alone).otherwise(both)).alias("e")).select("e.row", "e.col", "e.val")


def turned(s: SparkSession, d: str) -> DataFrame:
    """A matrix of pairs [a -b; b a], with eigenvalues a +- b i, from the customers' balances."""
    c = table(s, d, "customer").select((F.col("c_custkey") - F.lit(1)).alias("k"), (F.col("c_acctbal") / 100).alias("a"), (F.col("c_nationkey") + 1).cast("double").alias("b"))
    low = c.agg(F.min("k")).first()[0]
    i = (F.col("k") - low) * 2
    entry = lambda p, q, x: F.struct((i + p).alias("row"), (i + q).alias("col"), x.alias("val"))
    return c.select(F.explode(F.array(entry(0, 0, F.col("a")), entry(0, 1, -F.col("b")), entry(1, 0, F.col("b")), entry(1, 1, F.col("a")))).alias("e")).select("e.row", "e.col", "e.val")


def _pairs(method, k: int):
    """Eigenpairs (largest first) of A^T A for lineitem's matrix A: the leading value, and of each pair its residual, relative to the leading value, and whether it is orthonormal to those before."""

    def run(s, d):
        a = matrix(s, d)
        g = so.SparseMap(la.spmm(a, a, a_transposed=True), n_suppliers(s, d))
        values, x = method(g, min(k, g.shape[0]))
        residual = np.linalg.norm(np.column_stack([g(v) for v in x.T]) - x * values, axis=0) / abs(values[0])
        defect = np.abs(np.triu(x.T @ x - np.eye(len(values)))).max(axis=0)
        ordered = np.append(True, values[:-1] >= values[1:])
        rows = [(i, round(float(v), 2) if i == 0 else 0.0, bool(r <= 1e-9), bool(q <= 1e-8), bool(o)) for i, (v, r, q, o) in enumerate(zip(values, residual, defect, ordered, strict=True))]
        return s.createDataFrame(rows, "idx long, leading double, exact boolean, orthonormal boolean, ordered boolean")

    return run


def _top_sql(value: str) -> str:
    """The leading eigenvalue of A^T A by power steps, whose error falls by (lambda_2 / lambda_1)^2 each."""
    out = f"WITH a AS (SELECT * FROM {_A}), x0 AS (SELECT s_suppkey AS idx, 1.0::DOUBLE AS v FROM supplier)"
    for i in range(8):
        out += f""", y{i} AS (SELECT a.row AS idx, sum(a.val * x.v) AS v FROM a JOIN x{i} x ON a.col = x.idx GROUP BY a.row), z{i} AS (SELECT a.col AS idx, sum(a.val * y.v) AS v FROM a JOIN y{i} y ON a.row = y.idx GROUP BY a.col),
        x{i + 1} AS (SELECT idx, v / (SELECT sqrt(sum(v * v)) FROM z{i}) AS v FROM z{i})"""
    return out + f", top AS (SELECT sum(z7.v * x7.v) AS square FROM z7 JOIN x7 USING (idx)) {value}"


def _pairs_sql(k: int, value: str = "round(square, 2)") -> str:
    return _top_sql(f"SELECT i AS idx, CASE WHEN i = 0 THEN {value} ELSE 0 END AS leading, true AS exact, true AS orthonormal, true AS ordered FROM range(least({k}, (SELECT count(*) FROM supplier))) t(i), top")


def _triplets(s, d):
    """The three leading singular triplets of lineitem's matrix itself, as _pairs gives them: A v = sigma u and A^T u = sigma v."""
    a = so.SparseMap(matrix(s, d), table(s, d, "part").count(), n_suppliers(s, d))
    u, sigma, v = so.partial_svd(a, a.transposed, *a.shape, min(3, a.shape[1]))
    rows = []
    for i, value in enumerate(sigma):
        left = np.linalg.norm(a(v[:, i]) - value * u[:, i]) + np.linalg.norm(a.transposed(u[:, i]) - value * v[:, i])
        q = max(np.abs(m[:, : i + 1].T @ m[:, i] - (np.arange(i + 1) == i)).max() for m in (u, v))
        rows.append((i, round(float(value), 4) if i == 0 else 0.0, bool(left <= 1e-7 * sigma[0]), bool(q <= 1e-7), bool(i == 0 or sigma[i - 1] >= value)))
    return s.createDataFrame(rows, "idx long, leading double, exact boolean, orthonormal boolean, ordered boolean")


def _eigen(method, places: int = 4):
    """The values that `method` finds, by place."""

    def run(s, d):
        a = so.SparseMap(rotated(s, d), n_suppliers(s, d))
        return _vector(s, np.round(np.asarray(method(a, s, d), float), places) + 0.0, "eigenvalue")

    return run


def _balances(order: str, k: int = 5) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS idx, round(s_acctbal, 4) + 0.0 AS eigenvalue FROM supplier ORDER BY {order} LIMIT {k}"


def _diagonal(s, d) -> np.ndarray:
    out = np.zeros(n_suppliers(s, d))
    for r in rotated(s, d).filter("row = col").collect():
        out[r["row"]] = r["val"]
    return out


def _general(s, d):
    values = so.arnoldi_by_parts(turned(s, d), 2 * table(s, d, "customer").count(), 4, basis=60)
    return _vector(s, np.round(np.abs(values), 4), "magnitude")


def _norm(s, d):
    a = so.SparseMap(matrix(s, d), table(s, d, "part").count(), n_suppliers(s, d))
    return s.createDataFrame([(round(so.spectral_norm(a, a.transposed, a.shape[1], gram=a.gram), 4),)], "norm double")


def _power(s, d):
    """Three steps of x <- A^T A x / 1e6 from ones, as joins and sums."""
    a = matrix(s, d)
    x = s.range(n_suppliers(s, d)).select(F.col("id").alias("idx"), F.lit(1.0).alias("v"))
    for _ in range(3):
        x = la.spmv(a, la.spmv(a, x), alpha=1e-6, transposed=True)
    return x.select("idx", F.round("v", 3).alias("v"))


def _power_sql() -> str:
    out = f"WITH a AS (SELECT * FROM {_A}), x0 AS (SELECT s_suppkey AS idx, 1.0::DOUBLE AS v FROM supplier)"
    for i in range(3):
        out += f", y{i} AS (SELECT a.row AS idx, sum(a.val * x.v) AS v FROM a JOIN x{i} x ON a.col = x.idx GROUP BY a.row), x{i + 1} AS (SELECT a.col AS idx, 1e-6::DOUBLE * sum(a.val * y.v) AS v FROM a JOIN y{i} y ON a.row = y.idx GROUP BY a.col)"
    return out + " SELECT idx, round(v, 3) AS v FROM x3"


def _laplacian(s, d):
    """The Laplacian of x^2 + 3 y^2 at the parts' nodes: 8, as splines with quadratic monomials give exactly."""
    nodes = part_nodes.nodes(s, d).cache()
    w = pde.weights(sp.knn(nodes, nodes, 12), nodes, ["lap"])
    field = nodes.select(F.col("id").alias("idx"), (F.col("x")[0] ** 2 + 3 * F.col("x")[1] ** 2).alias("v"))
    return pde.apply(w, "lap", field).select("idx", F.round("v", 3).alias("v"))


def _poisson(s, d):
    """Poisson's equation with the solution x^2 - y^2 + x y on the boundary: the solution at all of the parts' nodes, from the assembled system."""
    nodes = part_nodes.nodes(s, d).cache()
    w = pde.weights(sp.knn(nodes, nodes, 12), nodes, ["lap"])
    exact = nodes.select(F.col("id").alias("idx"), "type", (F.col("x")[0] ** 2 - F.col("x")[1] ** 2 + F.col("x")[0] * F.col("x")[1]).alias("v"))
    a = cut_lineage(pde.assemble(w, {"lap": 1.0}, nodes.filter("type > 0")).unionByName(pde.dirichlet_rows(nodes)))
    n = nodes.count()
    b = np.zeros(n)
    for r in exact.filter("type < 0").collect():
        b[r["idx"]] = r["v"]
    x, _ = so.gmres(so.SparseMap(a, n), b, 1e-11, restart=100, prec=so.ilut(a, n, 1e-4, 60))
    return _vector(s, np.round(x, 5) + 0.0)


def _decay(s, d):
    start = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array((F.col("c_nationkey") + 1).cast("double")).alias("y"))
    done = pde.integrate_series(start, lambda t, y: -y, 1.0, 200)
    return done.select("id", F.round(F.col("y")[0], 6).alias("y"))


def _stiffness(s, d):
    return pde.p1_stiffness(*part_nodes.mesh(s, d)).select("row", "col", (F.round("val", 6) + 0.0).alias("val"))


def _h_matvec(s, d):
    """A smooth kernel over part points as an H-matrix times ones, against 1 / (1 + distance) summed up."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"))
    b = cl.bisect(p, ["x", "y"], 64, 16)
    blocks = cl.block_tree(cl.tree(b, ["x", "y"]), ["x", "y"], "two_min", 2.0)
    kernel = lambda a, c: 1.0 / (1.0 + np.sqrt(((a[:, None] - c[None]) ** 2).sum(axis=2)))
    h = lr.build(b.select("id", "node", F.array("x", "y").alias("x")), blocks, kernel, 1e-9)
    ones = p.select(F.col("id").alias("idx"), F.lit(1.0).alias("v"))
    return lr.h_matvec(h, ones).select("idx", F.round("v", 4).alias("v"))


def _jacobi(a: so.SparseMap) -> so.Apply:
    """Division by the diagonal, which probes of disjoint rows would give as well; here from the entries."""
    diagonal = a.diagonal()
    return lambda r: r / diagonal


def _nearest(a: so.SparseMap, s, d) -> np.ndarray:
    """The four eigenvalues nearest to 4321.5, in order; the shifted matrix is solved by dense inverses of its pairs."""
    return np.sort(so.shift_invert(so.inverse_by_components(a, 4321.5), 4321.5, a.shape[0], 4)[0])


QUERIES = {
    "power_iteration_k3": (_power, _power_sql()),
    "spectral_norm": (_norm, _top_sql("SELECT round(sqrt(square), 4) AS norm FROM top")),
    "cg": (_distributed(kr.cg), _KNOWN),
    "cg_jacobi": (_solve(lambda a, at, b: so.cg(a, b, prec=_jacobi(a))[0]), _KNOWN),
    "bicg": (_solve(lambda a, at, b: so.bicg(a, at, b)[0]), _KNOWN),
    "bicgstab": (_solve(lambda a, at, b: so.bicgstab(a, b)[0]), _KNOWN),
    "gmres": (_distributed(kr.gmres), _KNOWN),
    "gmres_restarted": (_solve(lambda a, at, b: so.gmres(a, b)[0]), _KNOWN),
    "lanczos_distributed": (_leading, _top_sql("SELECT round(sqrt(square), 3) AS sigma, true AS exact FROM top")),
    "solver_class": (_solve(lambda a, at, b: so.Solver(so.gmres, a, prec=_jacobi(a)).solve(b)), _KNOWN),
    "lanczos_topk": (_pairs(lambda a, k: so.lanczos(a, a.shape[0], k), 5), _pairs_sql(5)),
    "lanczos_spectrum": (_eigen(lambda a, s, d: so.lanczos(a, a.shape[0], 5)[0]), _balances("s_acctbal DESC")),
    "lanczos_smallest": (_eigen(lambda a, s, d: so.lanczos(a, a.shape[0], 5, rule="smallest_alge")[0]), _balances("s_acctbal")),
    "shift_invert": (_eigen(lambda a, s, d: _nearest(a, s, d)), "SELECT row_number() OVER (ORDER BY s_acctbal) - 1 AS idx, round(s_acctbal, 4) + 0.0 AS eigenvalue FROM (SELECT * FROM supplier ORDER BY abs(s_acctbal - 4321.5) LIMIT 4)"),
    "davidson": (_eigen(lambda a, s, d: so.davidson(a, _diagonal(s, d), 4)[0]), _balances("s_acctbal DESC", 4)),
    "lobpcg": (_eigen(lambda a, s, d: so.lobpcg(a, a.shape[0], 4, most=3000)[0], 3), _balances("s_acctbal", 4).replace("4) + 0.0", "3) + 0.0")),
    "arnoldi": (_general, "SELECT row_number() OVER (ORDER BY m DESC) - 1 AS idx, round(m, 4) AS magnitude FROM (SELECT unnest([sqrt((c_acctbal / 100) ** 2 + (c_nationkey + 1) ** 2), sqrt((c_acctbal / 100) ** 2 + (c_nationkey + 1) ** 2)]) AS m FROM customer) ORDER BY m DESC LIMIT 4"),
    "partial_svd": (_triplets, _pairs_sql(3, "round(sqrt(square), 4)")),
    "rbffd_laplacian": (_laplacian, "SELECT p_partkey AS idx, 8.0::DOUBLE AS v FROM part"),
    "poisson_implicit": (_poisson, f"SELECT idx, round(x * x - y * y + x * y, 5) + 0.0 AS v FROM {GRID}"),
    "rk4": (_decay, "SELECT c_custkey AS id, round((c_nationkey + 1) * exp(-1.0::DOUBLE), 6) AS y FROM customer"),
    "fem_p1_stiffness": (
        _stiffness,
        f"""WITH g AS (SELECT idx, x, y FROM {GRID}), t AS (SELECT * FROM {TRIANGLES}),
           q AS (SELECT t.id, a.idx AS v0, b.idx AS v1, c.idx AS v2, [c.x - b.x, a.x - c.x, b.x - a.x] AS ex, [c.y - b.y, a.y - c.y, b.y - a.y] AS ey FROM t JOIN g a ON a.idx = t.a JOIN g b ON b.idx = t.b JOIN g c ON c.idx = t.c)
           SELECT [v0, v1, v2][i] AS row, [v0, v1, v2][j] AS col, round(sum((ex[i] * ex[j] + ey[i] * ey[j]) / (2 * abs(ex[1] * ey[2] - ey[1] * ex[2]))), 6) + 0.0 AS val FROM q, range(1, 4) r(i), range(1, 4) s(j) GROUP BY ALL""",
    ),
    "h_matrix_matvec": (
        _h_matvec,
        "WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 20 AS y FROM part) SELECT a.id AS idx, round(sum(1.0 / (1.0 + sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))), 4) AS v FROM p a, p b GROUP BY a.id",
    ),
    "math_functions": (
        lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("n")).select(
            "id", mathx.int_power(F.col("n"), 3).alias("cube"), mathx.binomial(F.col("n"), 2).alias("pairs"), mathx.signum(F.col("n") - 10).alias("sign"), mathx.cell_index(F.col("n") - 9.5, 0.0, 2.0).alias("cell")
        ),
        "SELECT p_partkey AS id, i * i * i AS cube, i * (i - 1) // 2 AS pairs, CAST(sign(i - 10) AS INT) AS sign, CAST(trunc((i - 9.5) / 2.0) AS INT) AS cell FROM (SELECT p_partkey, p_size::BIGINT AS i FROM part)",
    ),
    "rbf_kernels": (
        lambda s, d: table(s, d, "part").select(
            F.col("p_partkey").alias("id"), *[F.round(f(F.col("p_size").cast("double")), 9).alias(n) for n, f in (("gauss", lambda r: mathx.gaussian(r, 2.0)), ("mq", mathx.multiquadric), ("imq", mathx.inverse_multiquadric), ("phs", mathx.polyharmonic))]
        ),
        "SELECT p_partkey AS id, round(exp(-i / 4.0::DOUBLE), 9) AS gauss, round(sqrt(i + 1.0::DOUBLE), 9) AS mq, round(1 / sqrt(i + 1.0::DOUBLE), 9) AS imq, round(pow(i::DOUBLE, 1.5), 9) AS phs FROM (SELECT p_partkey, p_size::DOUBLE AS i FROM part)",
    ),
    "memory_string": (
        lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id"), mathx.human_memory(F.pow(F.lit(7.0), F.col("c_nationkey") % 12)).alias("shown")),
        "SELECT c_custkey AS id, CASE WHEN b < 100 THEN printf('%.1f B', b) WHEN b / 1e3 < 100 THEN printf('%.1f kB', b / 1e3) WHEN b / 1e6 < 100 THEN printf('%.1f MB', b / 1e6) ELSE printf('%.1f GB', b / 1e9) END AS shown FROM (SELECT c_custkey, pow(7.0::DOUBLE, c_nationkey % 12) AS b FROM customer)",
    ),
    "split_join_pad": (
        lambda s, d: table(s, d, "documents").select(
            "doc_id", F.size(mathx.split_keep(F.col("text"), ".")).alias("pieces"), F.array_join(mathx.pad(F.slice(mathx.split_keep(F.col("source"), "c"), 1, 2), 3, F.lit("-")), "|").alias("padded")
        ),
        "SELECT doc_id, CAST(len(string_split(text, '.')) AS INT) AS pieces, array_to_string(list_concat(string_split(source, 'c')[1:2], ['-', '-', '-'])[1:3], '|') AS padded FROM documents",
    ),
}
