"""Claims that only larger tables show: on parts and suppliers made here, as they would be there."""

from __future__ import annotations

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from gridloom.operators import linalg as la
from gridloom.operators import pde
from gridloom.operators import spatial as sp
from gridloom.plans import registry


def test_points_on_a_polygons_edge_are_outside(spark):
    triangle = [(0.25, 0.5), (1.0, 0.5), (0.25, 1.25)]
    at = [(0.25, 0.75), (0.5, 0.5), (0.625, 0.875), (0.25, 0.5), (0.3, 0.6), (0.2, 0.6), (0.25, 1.5)]
    found = spark.createDataFrame([(i, list(p)) for i, p in enumerate(at)], "id int, x array<double>").filter(pde.in_polygon(F.col("x"), triangle))
    assert [r["id"] for r in found.collect()] == [4]


@pytest.fixture(scope="module")
def many_suppliers(tmp_path_factory, spark):
    d = str(tmp_path_factory.mktemp("suppliers"))
    spark.range(4000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{d}/supplier.parquet")
    return d


def test_rings_with_one_rounded_height_stay_apart(spark, many_suppliers):
    from oracle import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{many_suppliers}/supplier.parquet/*.parquet')")
    assert_same(registry.queries()["discretize_sphere"](spark, many_suppliers).toPandas(), c.sql(registry.oracle_sql()["discretize_sphere"]).df())


def test_neighbours_of_many_points_by_cells(spark):
    """Near ones, far ones, queries elsewhere and many copies of a point; by cells no task sees two whole blocks for each pair of them."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.random((300, 2)), 1e-3 * rng.random((300, 2)), np.full((90, 2), 0.25), 50 + rng.random((4, 2))])
    asked = np.concatenate([x[::3], rng.random((30, 2)) * 60 - 5])
    frame = lambda rows: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, x array<double>").repartition(3)
    points, queries = frame(x), frame(asked)
    assert "qb" not in sp.knn(queries, points, 7, 16)._jdf.queryExecution().analyzed().toString()
    got = sorted((r["id"], r["ord"], r["nbr"], r["d2"]) for r in sp.knn(queries, points, 7, 16).collect())
    d2 = (asked[:, None, 0] - x[None, :, 0]) ** 2 + (asked[:, None, 1] - x[None, :, 1]) ** 2
    assert got == [(i, o, int(j), float(row[j])) for i, row in enumerate(d2) for o, j in enumerate(np.argsort(row, kind="stable")[:7])]


def test_terms_of_a_local_product_are_summed_before_the_shuffle(spark):
    band = spark.range(3000).select(F.col("id").alias("row"), F.explode(F.sequence(F.greatest(F.col("id") - 5, F.lit(0)), F.least(F.col("id") + 5, F.lit(2999)))).alias("col"))
    a = band.withColumn("val", (F.col("row") * 3 + F.col("col") * 7).cast("double"))
    dense = np.zeros((3000, 3000))
    for r in a.collect():
        dense[r["row"], r["col"]] = r["val"]
    want = dense @ dense
    product = la.spmm(a, a).cache()
    assert "Join" not in product._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["row"], r["col"]): r["val"] for r in product.collect()} == {(int(i), int(j)): want[i, j] for i, j in zip(*np.nonzero(want), strict=True)}
    assert la.spmm(a.withColumn("row", F.lit(None).cast("long")), a, a_transposed=True).count() == 0


def test_stencils_are_solved_once_for_all_terms(spark):
    """The stencils' Python pass stands once in the plans of operators that take several of its rows."""
    from gridloom.operators import approx

    nodes = pde.box_nodes(spark, [0.0, 0.0], [1.0, 1.0], [5, 5])
    w = pde.weights(sp.knn(nodes, nodes, 9), nodes, ["lap", "d0", "d1", "d00", "d01", "d11"])
    velocity = nodes.select(F.col("id").alias("idx"), F.posexplode(F.array(F.lit(1.0), F.lit(2.0))).alias("axis", "v"))
    lap = w.filter("op = 'lap'").select(F.col("node").alias("row"), F.col("nbr").alias("col"), F.col("w").alias("val"))
    for found in (pde.convection_diffusion(w, velocity, 0.1, 2), approx.grad_div(w, 2, 25), approx.vector_laplacian(lap, 2, 25)):
        assert found._jdf.queryExecution().analyzed().toString().count("MapInPandas") == 1


def test_least_separator_of_a_cut_larger_than_the_driver_takes(spark):
    from gridloom.operators import domains

    rng = np.random.default_rng(8)
    pairs = {(a, 100 + b) for a in range(25) for b in range(60) if rng.random() < 0.9} | {(25 + i, 160 + i % 3) for i in range(40)}
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
    sides = spark.createDataFrame([(i, 0) for i in range(65)] + [(100 + i, 1) for i in range(63)], "id long, side int")
    cover = {r["id"] for r in domains.minimum_separator(e, sides, 1200, at_once=10).collect()}
    assert len(pairs) > 1200
    assert all(a in cover or b in cover for a, b in pairs)
    assert len(cover) == 25 + 3 == domains.minimum_separator(e, sides).count()


def test_shifted_inverse_holds_the_parts_only(spark):
    import tracemalloc

    from gridloom.operators import solvers as so

    rng = np.random.default_rng(2)
    n, cuts = 3000, np.cumsum(rng.integers(1, 6, 3000))
    part = np.searchsorted(cuts, np.arange(n), "right")
    moved = rng.permutation(n)
    rows = [(int(moved[i]), int(moved[j]), float(rng.random() + 9 * (i == j))) for i in range(n) for j in range(max(0, i - 5), min(n, i + 6)) if part[i] == part[j]]
    a = so.SparseMap(spark.createDataFrame(rows, "row long, col long, val double"), n)
    x = rng.random(n)
    tracemalloc.start()
    solved = so.inverse_by_components(a, 0.5)(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(a(solved) - 0.5 * solved - x).max() < 1e-10
    assert peak < 8 * n * n / 10


def test_diagonal_of_a_distributed_matrix(spark):
    from gridloom.operators import solvers as so
    from gridloom.plans import solver_queries as sq

    a = spark.createDataFrame([(i, (i + k) % 40, 1.0 + i * (k == 0)) for i in range(40) for k in (0, 3)], "row long, col long, val double")
    far = so.SparseMap(a, 40, local_entries=10)
    assert not far.local
    assert (sq._jacobi(far)(np.ones(40)) == 1 / (1.0 + np.arange(40))).all()


def test_eigenvalues_come_as_often_as_parts_have_them(spark):
    """copies of one part share their values, and no vector of all unknowns is on the driver; a larger part goes through the restarted basis."""
    from gridloom.operators import solvers as so

    pair = lambda i, x, y: [(i, i, x), (i, i + 1, -y), (i + 1, i, y), (i + 1, i + 1, x)]
    entries = [e for c in range(6) for e in pair(2 * c, 3.0, 4.0)] + [(20, 20, 5.5), (21, 21, 1.0), (21, 21, 1.5)]
    a = spark.createDataFrame(entries, "row long, col long, val double").repartition(3)
    assert np.allclose(np.abs(so.arnoldi_by_parts(a, 30, 5)), [5.5, 5, 5, 5, 5])
    assert np.allclose(np.sort(np.abs(so.arnoldi_by_parts(a, 30, 100))), [0] * 16 + [2.5] + [5] * 12 + [5.5])
    rng = np.random.default_rng(8)
    g = np.diag(np.arange(1.0, 13)) + 0.1 * rng.random((12, 12))
    big = spark.createDataFrame(entries + [(50 + i, 50 + j, float(g[i, j])) for i in range(12) for j in range(12)], "row long, col long, val double")
    want = np.sort(np.abs(np.concatenate([np.linalg.eigvals(g), [5.5], [5.0] * 12])))[::-1][:6]
    assert np.allclose(np.abs(so.arnoldi_by_parts(big, 70, 6, whole=8)), want)


def test_a_normal_product_takes_one_pass(spark):
    """batches hold whole rows, so A^T A x is a sum over them."""
    from gridloom.operators import solvers as so

    rng = np.random.default_rng(9)
    dense = np.where(rng.random((90, 40)) < 0.4, rng.integers(1, 9, (90, 40)), 0).astype(float)
    a = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], "row long, col long, val double")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        far = so.SparseMap(a, 90, 40, local_entries=10)
    finally:
        spark.conf.set(batch, old)
    x = rng.random(40)
    assert np.allclose(far.gram(x), dense.T @ (dense @ x)) and np.allclose(far(x), dense @ x)
    assert np.isclose(so.spectral_norm(far, far.transposed, 40, 60, gram=far.gram), np.linalg.norm(dense, 2))


def test_bytes_of_a_large_block_are_counted_in_longs(spark):
    from gridloom.operators import lowrank as lr

    block = spark.range(1).select(F.array_repeat(F.lit(1).cast("long"), 17000).alias("rows"), F.array_repeat(F.lit(1).cast("long"), 16000).alias("cols"))
    assert block.agg(F.sum(lr.dense_size())).first()[0] == 8 * 17000 * 16000


def test_condition_of_many_small_parts_is_found_without_a_dense_matrix():
    """60000 unknowns as one dense matrix would be 29 GB."""
    from gridloom.operators import solvers as so

    n = 60000
    assert np.isclose(so.condition_by_parts(np.arange(n), np.arange(n), np.arange(1.0, n + 1), n), n)
    rng = np.random.default_rng(5)
    a = np.zeros((12, 12))
    a[np.ix_([0, 5, 7], [0, 5, 7])], a[np.ix_([1, 2], [1, 2])] = rng.random((3, 3)), rng.random((2, 2))
    a[[3, 4, 6, 8, 9, 10, 11], [3, 4, 6, 8, 9, 10, 11]] = np.arange(2.0, 9)
    p, q = np.nonzero(a)
    assert np.isclose(so.condition_by_parts(np.append(p, p), np.append(q, q), np.append(a[p, q], a[p, q]) / 2, 12), np.linalg.cond(a, np.inf))
    assert so.condition_by_parts(np.array([0]), np.array([0]), np.array([1.0]), 2) == np.inf


def test_boxes_of_parts_are_not_planned_by_their_file(spark):
    """a file of parts is small and its nodes, in all their cells, aren't; no side is taken for a broadcast before its size is known."""
    from gridloom.plans import domain_queries

    a, b = domain_queries._boxes(spark, "/root/testdata/sf0.001")
    assert all(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 40 for x in (a, b))
