"""Queries over dense, low-rank, tiled and H2 blocks: what comes out is known in closed form or by a join."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import h2, harith
from ..operators import h2basis as hb
from ..operators import hmatrix as hm
from ..operators import linalg as la
from ..operators import lowrank as lr
from ..operators import normal
from ..operators import solvers as so
from ..session import cut_lineage, table
from .linalg_queries import n_suppliers
from .solver_queries import _KNOWN, _known, _vector, gram, gram_blocks

_GRAM = """(SELECT row, col, sum(val) AS val FROM (
  SELECT a.col AS row, b.col AS col, 1e-4::DOUBLE * a.val * b.val AS val FROM {a} a JOIN {a} b ON a.row = b.row
  UNION ALL SELECT s_suppkey, s_suppkey, 0.2::DOUBLE FROM supplier) GROUP BY row, col)"""
from .linalg_queries import _A  # noqa: E402

_GRAM = _GRAM.format(a=_A)
_TILE = 32


def _entries(s: SparkSession, m: np.ndarray, places: int = 6) -> DataFrame:
    rows = [(int(i), int(j), float(round(m[i, j], places)) + 0.0) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return s.createDataFrame(rows, "row long, col long, val double")


def _corner(s, d, n: int = 8) -> np.ndarray:
    """The first rows and columns of the Gram matrix, as dense kernels get them."""
    out = np.zeros((n, n))
    for r in la.block_slice(gram(s, d), 0, 0, n, n).collect():
        out[r["row"], r["col"]] = r["val"]
    return out


def _dense(work: Callable[[np.ndarray], np.ndarray]):
    return lambda s, d: _entries(s, work(_corner(s, d)))


_CORNER = f"SELECT i AS row, j AS col, round(coalesce(val, 0), 6) AS val FROM range(8) a(i) JOIN range(8) b(j) ON true LEFT JOIN {_GRAM} g ON g.row = i AND g.col = j"
_EYE = "SELECT i AS row, j AS col, (i = j)::INT::DOUBLE AS val FROM range(8) a(i), range(8) b(j)"


def _bunch(a):
    p, low, dd = so.bunch_kaufman(a)
    back = np.argsort(p)
    return (low @ dd @ low.T)[np.ix_(back, back)]


def _qr(a):
    h = np.triu(a, -1)
    q, r = so.hessenberg_qr(h)
    return np.tril(a, -2) + q @ r


def _columns(x: np.ndarray) -> np.ndarray:
    return np.stack([x, x * x, np.ones(len(x))], axis=1)


def _factors(work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], rank: int = 3):
    """The row sums of blocks of rank three, i j + i^2 + j^2 for the sizes i of a brand's parts and the nations' keys j, from factors that `work` finds; one block for each brand."""

    def run(s, d):
        keys = np.array(sorted(r[0] for r in table(s, d, "nation").select("n_nationkey").collect()), float)
        right = np.stack([keys, np.ones(len(keys)), keys * keys], axis=1)

        def block(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("p_partkey")
            u, v = work(_columns(f["p_size"].to_numpy(float)), right)
            if u.shape[1] > rank:
                raise RuntimeError(f"rank {u.shape[1]}")
            return pd.DataFrame({"id": f["p_partkey"], "v": np.round(u @ v.sum(axis=0), 3)})

        return table(s, d, "part").select("p_partkey", "p_size", "p_brand").groupBy("p_brand").applyInPandas(block, "id long, v double")

    return run


_RANK3 = "SELECT p_partkey AS id, round(sum(p_size * n_nationkey + p_size * p_size + n_nationkey * n_nationkey)::DOUBLE, 3) AS v FROM part, nation GROUP BY p_partkey"


def _traced(s, d):
    """Of each brand's block: which ranks give it exactly; it has as many as it has sizes, three at most."""
    keys = np.array(sorted(r[0] for r in table(s, d, "nation").select("n_nationkey").collect()), float)
    right = np.stack([keys, np.ones(len(keys)), keys * keys], axis=1)

    def block(f: pd.DataFrame) -> pd.DataFrame:
        trace = so.Truncation("svd", 1e-10).trace(_columns(f["p_size"].to_numpy(float)), right)
        return pd.DataFrame([(f["p_brand"].iloc[0], k, bool(e < 1e-6)) for k, e in trace], columns=["brand", "rank", "exact"])

    return table(s, d, "part").select("p_size", "p_brand").groupBy("p_brand").applyInPandas(block, "brand string, rank long, exact boolean")


def _partition(s, d) -> DataFrame:
    return harith.even_partition(table(s, d, "supplier").select(F.col("s_suppkey").alias("idx")), _TILE)


def _tiles(s, d):
    part = _partition(s, d).cache()
    n = n_suppliers(s, d)
    return harith.from_blocks(gram_blocks(s, d), _TILE, n, 1e-12), part, -(-n // _TILE)


def _rounded(a: DataFrame, places: int = 4) -> DataFrame:
    return a.select("row", "col", F.round("val", places).alias("val")).filter("val <> 0")


def _copied(s, d):
    return _rounded(harith.even_entries(_tiles(s, d)[0], _TILE))


def _multiplied(form: str):
    def run(s, d):
        t, part, _ = _tiles(s, d)
        out = harith.multiply_add(t, t, t, 1e-3, 1e-12, form)
        return _rounded(harith.entries(harith.evaluated(out, 1e-12) if form == "sum" else out, part))

    return run


def _solved(s, d):
    t, part, n = _tiles(s, d)
    a = so.SparseMap(gram(s, d), n_suppliers(s, d))
    b = _vector(s, a(_known(a.shape[0])))
    return harith.solve(harith.lu(t, n, 1e-12), b, part, n).select("idx", F.round("v", 4).alias("v"))


def _cholesky(s, d):
    t, part, n = _tiles(s, d)
    low = harith.cholesky(t, n, 1e-12)
    return _rounded(harith.entries(harith.triangular_product(low, harith.transposed(low), True, 1e-12), part))


def _inverse(s, d):
    t, part, n = _tiles(s, d)
    product = harith.multiply_add(None, harith.inverse(t, part, n, 1e-13), t, 1.0, 1e-13)
    return _rounded(harith.entries(product, part)).withColumn("val", F.col("val") + 0.0)


def _split_merged(s, d):
    halved = harith.merged(harith.split(_tiles(s, d)[0], 1e-12), 1e-12)
    return _rounded(harith.even_entries(halved, _TILE))


def _sum(s, d):
    t, _, _ = _tiles(s, d)
    return _rounded(harith.even_entries(harith.add(t, harith.transposed(t), 1.0, 1e-12), _TILE))


def _points(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))


def _h2(s, d):
    """The kernel |x - y|^2, which three interpolation points an axis give exactly, times ones."""
    leaves = cl.bisect(_points(s, d), ["x", "y"], 40, 20)
    nodes = cl.tree(leaves, ["x", "y"])
    blocks = cl.block_tree(nodes, ["x", "y"], "two_min", 1.0)
    kernel = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(axis=2)
    points = leaves.select("id", "node", F.array("x", "y").alias("x"))
    x = points.select(F.col("id").alias("idx"), F.lit(1.0).alias("v"))
    return h2.matvec(points, nodes, ["x", "y"], blocks, kernel, x, 3).select("idx", F.round(F.col("v") / 997, 3).alias("v"))


def _bases(s, d):
    """The same matrix with stored bases."""
    leaves = cl.bisect(_points(s, d), ["x", "y"], 150, 20)
    nodes = cl.tree(leaves, ["x", "y"]).cache()
    blocks = cl.block_tree(nodes, ["x", "y"], "two_min", 1.0)
    kernel = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(axis=2)
    return hb.from_kernel(leaves.select("id", "node", F.array("x", "y").alias("x")), nodes, ["x", "y"], blocks, kernel, 3)


def _by_bases(change):
    """The stored matrix after `change`, times ones."""

    def run(s, d):
        ones = table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.lit(1.0).alias("v"))
        return hb.matvec(change(s, d, _bases(s, d)), ones).select("idx", F.round(F.col("v") / 997, 3).alias("v"))

    return run


def _updated(s, d, h):
    """Plus sizes times the keys modulo 7, compressed again."""
    p = table(s, d, "part")
    a = p.select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("v"))
    b = p.select(F.col("p_partkey").alias("idx"), (F.col("p_partkey") % 7).cast("double").alias("v"))
    return hb.compressed(hb.orthogonalized(hb.updated(h, a, b)), 1e-13)


def _bases_ranks(s, d):
    """The greatest rank of a basis before compression, of nine points of interpolation, and whether it is the kernel's own, four, at most after it."""
    h = _bases(s, d)
    most = lambda m, name: hb.ranks(m).agg(F.max("k").alias(name), F.lit(1).alias("_k"))
    return most(h, "before").join(most(hb.compressed(hb.orthogonalized(h), 1e-10), "after"), "_k").select("before", (F.col("after") <= 4).alias("compressed"))


def _moments(s, d):
    """Forward transform at the root with one point an axis: the sum of x."""
    leaves = cl.bisect(_points(s, d), ["x", "y"], 40, 20)
    x = leaves.select(F.col("id").alias("idx"), F.col("x").alias("v"))
    points = leaves.select("id", "node", F.array("x", "y").alias("x"))
    return h2.forward(points, cl.tree(leaves, ["x", "y"]), ["x", "y"], x, 1).filter("node = 1").select(F.round(F.col("c")[0], 3).alias("total"))


def _low_rank_matrix(s, d):
    """A kernel of rank three over parts as an H-matrix: 1 + x y, by blocks."""
    p = _points(s, d)
    b = cl.bisect(p, ["x", "y"], 64, 16)
    blocks = cl.block_tree(cl.tree(b, ["x", "y"]), ["x", "y"], "two_min", 2.0)
    kernel = lambda a, c: 1.0 + a @ c.T
    return p, lr.build(b.select("id", "node", F.array("x", "y").alias("x")), blocks, kernel, 1e-10)


def _h_sum(s, d):
    p, h = _low_rank_matrix(s, d)
    ones = p.select(F.col("id").alias("idx"), F.lit(1.0).alias("v"))
    twice = lr.recompress(lr.add(h, lr.scale(h, 2.0), 1e-10), 1e-10)
    return lr.h_matvec(twice, ones).select("idx", F.round(F.col("v") / 997, 3).alias("v"))


def _h_ranks(s, d):
    """The greatest rank of the kernel's low-rank blocks, and whether they are smaller than dense ones would be."""
    _, h = _low_rank_matrix(s, d)
    full = h.filter("kind <> 'dense'").agg(F.coalesce(F.sum(lr.dense_size()), F.lit(0)).alias("full"), F.lit(1).alias("k"))
    return lr.storage(h).withColumn("k", F.lit(1)).join(full, "k").select("max_rank", (F.col("lowrank_bytes") <= F.col("full")).alias("smaller"))


#: Positions of a leaf of the suppliers' halved tree.
_LEAF = 8


def _h_gram(s, d):
    """The Gram matrix as an H-matrix of several levels over the halved suppliers, and its tree and blocks."""
    n = n_suppliers(s, d)
    nodes = hm.index_tree(s, n, _LEAF).cache()
    blocks = hm.weak_blocks(nodes).cache()
    return hm.from_blocks(gram_blocks(s, d), nodes, n, _LEAF, 1e-14), nodes, blocks


def _h_copied(s, d):
    h, nodes, _ = _h_gram(s, d)
    return _rounded(hm.entries(h, nodes))


def _h_multiplied(s, d):
    h, nodes, blocks = _h_gram(s, d)
    return _rounded(hm.entries(hm.multiply_add(h, h, h, nodes, blocks, 1e-3, 1e-14), nodes))


def _h_added(s, d):
    h, nodes, blocks = _h_gram(s, d)
    return _rounded(hm.entries(hm.add(h, hm.transposed(h), nodes, blocks, 1.0, 1e-14), nodes))


def _h_solved(s, d):
    h, nodes, _ = _h_gram(s, d)
    known = table(s, d, "supplier").select(F.col("s_suppkey").alias("idx"), (F.lit(1.0) + F.col("s_suppkey") % 7).alias("v"))
    return hm.solve(hm.factor(h, nodes), la.spmv(gram(s, d), known)).select("idx", (F.round("v", 4) + 0.0).alias("v"))


def _h_kernel_product(s, d):
    """K K times ones, for the kernel 1 + x . y over parts in blocks of several levels; whole numbers, exactly."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 25).cast("double").alias("x"), (F.floor(F.col("p_retailprice") / 100) - 14).cast("double").alias("y"))
    leaves = cl.bisect(p, ["x", "y"], 64, 20)
    nodes = hm.placed(cl.tree(leaves, ["x", "y"])).cache()
    blocks = cl.block_tree(nodes, ["x", "y"], "two_min", 2.0).cache()
    at = hm.positions(leaves, nodes).cache()
    points = at.join(p, "id").select(F.col("pos").alias("id"), "node", F.array("x", "y").alias("x"))
    k = lr.build(points, blocks, lambda a, c: 1.0 + a @ c.T, 1e-13)
    k = cut_lineage(k.select(F.col("r_node").alias("i"), F.col("c_node").alias("j"), F.size("rows").alias("m"), F.size("cols").alias("n"), "kind", "rank", "a", "b"))
    ones = at.select(F.col("pos").alias("idx"), F.lit(1.0).alias("v"))
    found = hm.matvec(hm.multiply_add(None, k, k, nodes, blocks, 1.0, 1e-13), nodes, ones)
    return found.join(at.select(F.col("pos").alias("idx"), "id"), "idx").select("id", F.round("v").cast("long").alias("v"))


def _uzawa(s, d):
    """[A B^T; B 0] for suppliers and nations, with the known velocity: B sums suppliers by nation, and each nation's own weight makes it regular."""
    g = so.SparseMap(gram(s, d), n_suppliers(s, d))
    n = g.shape[0]
    dense = np.zeros((n, n))
    dense[g.row, g.col] = g.val
    factor = np.linalg.inv(dense)
    rows = table(s, d, "supplier").select("s_suppkey", "s_nationkey").collect()
    used = sorted({r["s_nationkey"] for r in rows})
    b = np.zeros((len(used), n))
    for r in rows:
        b[used.index(r["s_nationkey"]), r["s_suppkey"]] = 1.0
    x, p = _known(n), np.arange(len(used)) * 1.0
    return factor, dense, b, x, p


def _uzawa_velocity(s, d):
    factor, dense, b, x, p = _uzawa(s, d)
    u, _, _ = so.uzawa(lambda r: factor @ r, lambda r: b @ r, lambda r: b.T @ r, dense @ x + b.T @ p, b @ x)
    return _vector(s, np.round(u, 4) + 0.0)


def _saddle_by_blocks(coupled: bool):
    """The same system by GMRES with a block preconditioner of the exact blocks."""

    def run(s, d):
        factor, dense, b, x, p = _uzawa(s, d)
        n = len(x)
        schur = np.linalg.inv(-b @ factor @ b.T)
        a = lambda r: np.concatenate([dense @ r[:n] + b.T @ r[n:], b @ r[:n]])
        prec = so.block_preconditioner(lambda r: factor @ r, lambda r: schur @ r, lambda r: b @ r, n, coupled)
        found, _ = so.gmres(a, np.concatenate([dense @ x + b.T @ p, b @ x]), 1e-12, restart=60, prec=prec)
        return _vector(s, np.round(found[:n], 4) + 0.0)

    return run


def _schur(s, d):
    """(C - D A^-1 G) x with A = 2 I, D = G^T sums by nation and C = I, times ones: 1 - suppliers / 2, nation by nation."""
    _, _, b, _, _ = _uzawa(s, d)
    y = so.schur_map(lambda r: r, lambda r: b @ r, lambda r: b.T @ r, lambda r: r / 2.0)(np.ones(len(b)))
    used = sorted({r["s_nationkey"] for r in table(s, d, "supplier").select("s_nationkey").distinct().collect()})
    return s.createDataFrame([(int(k), float(v)) for k, v in zip(used, y, strict=True)], "nation int, v double")


def _quality(s, d):
    """The norm of I - P^-1 A for P = A / (1 - 0.25): a quarter."""
    g = so.SparseMap(gram(s, d), n_suppliers(s, d))
    n = g.shape[0]
    dense = np.zeros((n, n))
    dense[g.row, g.col] = g.val
    inverse = 0.75 * np.linalg.inv(dense)
    return s.createDataFrame([(round(so.preconditioner_quality(g, g.transposed, lambda r: inverse @ r, lambda r: inverse.T @ r, n), 6),)], "quality double")


def _ilut(s, d):
    g = gram(s, d)
    a = so.SparseMap(g, n_suppliers(s, d))
    b = a(_known(a.shape[0]))
    x, _ = so.gmres(a, b, 1e-12, prec=so.ilut(g, a.shape[0], 1e-6, a.shape[0]))
    return _vector(s, np.round(x, 4) + 0.0)


_SUMS = "SELECT a.p_partkey AS idx, round({0}, 3) AS v FROM part a, part b GROUP BY a.p_partkey"
_SQUARES = "sum((a.p_size - b.p_size)::DOUBLE ** 2 + (a.p_retailprice / 100 - b.p_retailprice / 100) ** 2) / 997"
_NONZERO = "SELECT row, col, val FROM ({0}) WHERE val <> 0"

QUERIES = {
    "dense_lu": (_dense(lambda a: so.lu(a)[0] @ so.lu(a)[1]), _CORNER),
    "dense_ldlt": (_dense(lambda a: so.ldlt(a)[0] @ np.diag(so.ldlt(a)[1]) @ so.ldlt(a)[0].T if so.ldlt(a)[1].ndim == 1 else so.ldlt(a)[0] @ so.ldlt(a)[1] @ so.ldlt(a)[0].T), _CORNER),
    "dense_bunch_kaufman": (_dense(_bunch), _CORNER),
    "dense_hessenberg_qr": (_dense(_qr), _CORNER),
    "dense_triangular": (_dense(lambda a: so.triangular(np.tril(a), np.tril(a) @ np.eye(8))), _EYE),
    "dense_eigen": (_dense(lambda a: (np.linalg.eigh(a)[1] * np.linalg.eigh(a)[0]) @ np.linalg.eigh(a)[1].T), _CORNER),
    "orthogonalizers": (_dense(lambda a: sum(so.orthogonalized(a, m).T @ so.orthogonalized(a, m) for m in ("modified", "twice", "householder", "cholesky")) / 4), _EYE),
    "lowrank_truncation": (_factors(lambda a, b: lr.truncate(np.column_stack([a, a]), np.column_stack([b, 0 * b]), 1e-10)), _RANK3),
    "lowrank_sum": (_factors(lambda a, b: lr.truncated_sum([(a, 0.25 * b), (0.75 * a, b)], 1e-10)), _RANK3),
    "lowrank_randomized": (_factors(lambda a, b: lr.randomized(lambda x: a @ (b.T @ x), lambda x: b @ (a.T @ x), len(b), 1e-9)), _RANK3),
    "lowrank_lanczos": (_factors(lambda a, b: harith.lanczos_truncation(lambda x: a @ (b.T @ x), lambda x: b @ (a.T @ x), len(a), len(b), 1e-9)), _RANK3),
    "lowrank_cross": (_factors(lambda a, b: lr.truncate(*lr.cross_approximation(lambda i: a[i] @ b.T, lambda j: a @ b[j], len(a), len(b), 1e-12), 1e-10)), _RANK3),
    "truncation_class": (_factors(lambda a, b: so.Truncation("lanczos", 1e-9)(a, b)), _RANK3),
    "truncation_trace": (_traced, "SELECT p_brand AS brand, i AS rank, i >= n AS exact FROM (SELECT p_brand, least(count(DISTINCT p_size), 3) AS n FROM part GROUP BY p_brand), range(4) t(i) WHERE i <= n"),
    "tiles_from_sparse": (_copied, _NONZERO.format(f"SELECT row, col, round(val, 4) AS val FROM {_GRAM}")),
    **{
        f"tiles_multiply_add_{form}": (_multiplied(form), _NONZERO.format(f"WITH g AS {_GRAM} SELECT row, col, round(sum(val), 4) AS val FROM (SELECT * FROM g UNION ALL SELECT a.row, b.col, 1e-3::DOUBLE * a.val * b.val FROM g a JOIN g b ON a.col = b.row) GROUP BY row, col"))
        for form in ("standard", "accumulator", "sum")
    },
    "tiles_lu_solve": (_solved, _KNOWN),
    "tiles_cholesky": (_cholesky, _NONZERO.format(f"SELECT row, col, round(val, 4) AS val FROM {_GRAM}")),
    "tiles_inverse": (_inverse, "SELECT s_suppkey AS row, s_suppkey AS col, 1.0::DOUBLE AS val FROM supplier"),
    "tiles_split_merge": (_split_merged, _NONZERO.format(f"SELECT row, col, round(val, 4) AS val FROM {_GRAM}")),
    "tiles_add": (_sum, _NONZERO.format(f"SELECT row, col, round(2 * val, 4) AS val FROM {_GRAM}")),
    "tiles_norm": (lambda s, d: harith.norm(_tiles(s, d)[0]).select(F.round("norm", 4).alias("norm")), f"SELECT round(sqrt(sum(val * val)), 4) AS norm FROM {_GRAM}"),
    "tiles_histogram": (lambda s, d: harith.leaf_histogram(_tiles(s, d)[0]).agg(F.sum("tiles").alias("tiles"), F.max(F.when(F.col("kind") == "lowrank", F.col("rank")).otherwise(0) <= _TILE).alias("bounded")), f"SELECT (ceil(count(*) / {_TILE}.0) ** 2)::BIGINT AS tiles, true AS bounded FROM supplier"),
    "hmatrix_from_sparse": (_h_copied, _NONZERO.format(f"SELECT row, col, round(val, 4) AS val FROM {_GRAM}")),
    "hmatrix_multiply_add": (_h_multiplied, _NONZERO.format(f"WITH g AS {_GRAM} SELECT row, col, round(sum(val), 4) AS val FROM (SELECT * FROM g UNION ALL SELECT a.row, b.col, 1e-3::DOUBLE * a.val * b.val FROM g a JOIN g b ON a.col = b.row) GROUP BY row, col")),
    "hmatrix_add": (_h_added, _NONZERO.format(f"SELECT row, col, round(2 * val, 4) AS val FROM {_GRAM}")),
    "hmatrix_solve": (_h_solved, _KNOWN),
    "hmatrix_levels": (
        lambda s, d: hm.leaf_counts(hm.with_absent(*_h_gram(s, d))),
        f"""WITH n AS (SELECT count(*) AS n FROM supplier), d AS (SELECT min(i) AS depth FROM n, range(40) t(i) WHERE ceil(n / 2.0 ** i) <= {_LEAF})
            SELECT i::INT AS level, 'lowrank' AS kind, (2 ** i)::BIGINT AS blocks FROM d, range(1, 40) t(i) WHERE i <= depth UNION ALL SELECT depth::INT, 'dense', (2 ** depth)::BIGINT FROM d""",
    ),
    "hmatrix_kernel_product": (
        _h_kernel_product,
        """WITH p AS (SELECT p_partkey AS id, (p_size - 25)::DOUBLE AS x, floor(p_retailprice / 100) - 14 AS y FROM part),
           o AS (SELECT a.id, a.x, a.y, sum(1 + a.x * b.x + a.y * b.y) AS v FROM p a, p b GROUP BY ALL)
           SELECT a.id, CAST(round(sum((1 + a.x * b.x + a.y * b.y) * b.v)) AS BIGINT) AS v FROM p a, o b GROUP BY a.id""",
    ),
    "h2_matvec": (_h2, _SUMS.format(_SQUARES)),
    "h2_orthogonal_bases": (_by_bases(lambda s, d, h: hb.orthogonalized(h)), _SUMS.format(_SQUARES)),
    "h2_compressed_bases": (_by_bases(lambda s, d, h: hb.compressed(hb.orthogonalized(h), 1e-12)), _SUMS.format(_SQUARES)),
    "h2_compressed_ranks": (_bases_ranks, "SELECT 9::INT AS before, true AS compressed"),
    "h2_update": (_by_bases(_updated), _SUMS.format("sum((a.p_size - b.p_size)::DOUBLE ** 2 + (a.p_retailprice / 100 - b.p_retailprice / 100) ** 2 + a.p_size * (b.p_partkey % 7)) / 997")),
    "cluster_basis_forward": (_moments, "SELECT round(sum(p_size)::DOUBLE, 3) AS total FROM part"),
    "h_matrix_sum": (_h_sum, _SUMS.format("3 * sum(1 + a.p_size * b.p_size + (a.p_retailprice / 100) * (b.p_retailprice / 100)) / 997")),
    "h_matrix_ranks": (_h_ranks, "SELECT 3::INT AS max_rank, true AS smaller"),
    "uzawa": (_uzawa_velocity, _KNOWN),
    "saddle_block_triangular": (_saddle_by_blocks(True), _KNOWN),
    "saddle_block_diagonal": (_saddle_by_blocks(False), _KNOWN),
    "schur_map": (_schur, "SELECT s_nationkey AS nation, 1 - count(*) / 2.0::DOUBLE AS v FROM supplier GROUP BY s_nationkey"),
    "preconditioner_quality": (_quality, "SELECT 0.25::DOUBLE AS quality"),
    "ilut": (_ilut, _KNOWN),
    "symmetry_check": (lambda s, d: normal.asymmetry(gram_blocks(s, d)).select(F.round("asymmetry", 9).alias("asymmetry")), "SELECT 0.0::DOUBLE AS asymmetry"),
    "orthogonality_check": (
        lambda s, d: la.orthogonality(s.range(n_suppliers(s, d)).select(F.col("id").alias("row"), ((F.col("id") + 7) % n_suppliers(s, d)).alias("col"), F.lit(1.0).alias("val")), n_suppliers(s, d)),
        "SELECT 0.0::DOUBLE AS defect",
    ),
    "csr_diagonal_first": (
        lambda s, d: la.diagonal_first(gram(s, d)).select("row", "ord", "col"),
        f"SELECT row, (row_number() OVER (PARTITION BY row ORDER BY (row <> col)::INT, col) - 1)::INT AS ord, col FROM {_GRAM}",
    ),
    "csr_round_trip": (lambda s, d: _rounded(la.from_csr(la.as_csr(gram(s, d)))), _NONZERO.format(f"SELECT row, col, round(val, 4) AS val FROM {_GRAM}")),
    "sort_by_comparator": (
        lambda s, d: la.sorted_by(table(s, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", lambda a, b: (a % 10 < b % 10) | ((a % 10 == b % 10) & (a > b))).select("c_nationkey", F.array_join("c_custkey", ",").alias("keys")),
        "SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey % 10, c_custkey DESC) AS keys FROM customer GROUP BY c_nationkey",
    ),
}
