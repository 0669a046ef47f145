"""Normal products by blocks, against dense algebra; what takes them gets the same as from entries."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.operators import harith, normal
from gridloom.operators import krylov as kr
from gridloom.operators import solvers as so


@pytest.fixture()
def small_blocks(monkeypatch):
    """Blocks of 8 columns; workers read the module's numbers anew, so what they run is called with it."""
    monkeypatch.setattr(normal, "BLOCK", 8)
    monkeypatch.setattr(normal, "SUMMED", 16)
    monkeypatch.setattr(normal, "TERMS", 50)


def local(a: np.ndarray):
    """The steps of a product without a session: batches to pairs, pairs to blocks."""
    import pandas as pd

    p, q = np.nonzero(a)
    f = pd.DataFrame({"row": np.repeat(p, 2), "col": np.repeat(q, 2), "val": np.repeat(a[p, q] / 2, 2)})
    out = {}
    for batch in normal._dealt(iter([f[:37], f[37:]])):
        for r in batch.itertuples(index=False):
            left = np.frombuffer(r.l_row, np.int32), np.frombuffer(r.l_col, np.uint16), np.frombuffer(r.l_val)
            right = left if r.i == r.j else (np.frombuffer(r.r_row, np.int32), np.frombuffer(r.r_col, np.uint16), np.frombuffer(r.r_val))
            normal._terms(out.setdefault((r.i, r.j), np.zeros((normal.BLOCK, normal.BLOCK))), left, right)
    return out


def test_blocks_of_rows_over_several_of_them(small_blocks):
    rng = np.random.default_rng(7)
    a = np.where(rng.random((60, 21)) < 0.3, rng.integers(1, 9, (60, 21)), 0).astype(float)
    a[:, 8:16] *= (np.arange(60) % 3 == 0)[:, None]
    want = np.zeros((24, 24))
    want[:21, :21] = a.T @ a
    found = local(a)
    assert set(found) <= {(i, j) for i in range(3) for j in range(i, 3)}
    for i in range(3):
        for j in range(i, 3):
            assert np.allclose(found.get((i, j), np.zeros((8, 8))), want[8 * i : 8 * i + 8, 8 * j : 8 * j + 8])


def test_solvers_and_tiles_take_blocks(spark):
    n = normal.BLOCK + 130
    rng = np.random.default_rng(8)
    rows, cols = np.repeat(np.arange(900), 6), rng.integers(0, n, 5400)
    cols[::6] = normal.BLOCK - 8 + np.arange(900) % 20
    a = spark.createDataFrame([(int(i), int(j), float(1 + (i + j) % 5)) for i, j in zip(rows, cols, strict=True)], "row long, col long, val double").repartition(3)
    dense = np.zeros((900, n))
    np.add.at(dense, (rows, cols), 1.0 + (rows + cols) % 5)
    want = 0.01 * dense.T @ dense + 0.5 * np.eye(n)
    blocks = normal.product(a, n, 0.01, 0.5)
    assert sorted((r["i"], r["j"]) for r in blocks.select("i", "j").collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert normal.asymmetry(blocks).first()[0] < 1e-14
    x = 1.0 + np.arange(n) % 7
    for limit in (0, 10**7):
        m = so.BlockMap(blocks, n, limit)
        assert m.local == bool(limit)
        assert np.allclose(m(x), want @ x) and np.allclose(m.transposed(x), want @ x) and np.allclose(m.diagonal(), np.diag(want))
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(want @ x)], "idx long, v double")
    g = kr.BlockMatrix(blocks, n, normal.BLOCK, packed=True)
    for method in (kr.cg, kr.gmres):
        found, _ = method(g, table)
        assert np.allclose([r["v"] for r in found.orderBy("idx").collect()], x, atol=1e-6)
    tiles = harith.even_entries(harith.from_blocks(blocks, 32, n, 1e-13), 32).collect()
    back = np.zeros((n, n))
    for r in tiles:
        back[r["row"], r["col"]] = r["val"]
    assert np.allclose(back, want, atol=1e-9)


def test_a_product_of_the_matrix_deals_no_blocks(spark):
    """The matrix isn't shuffled for each step."""
    a = spark.createDataFrame([(i, i, 2.0) for i in range(40)], "row long, col long, val double")
    m = kr.BlockMatrix(a, 40, 8)
    plans = []
    old = kr.cut_lineage
    try:
        kr.cut_lineage = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
        m.times(m.vector(spark.createDataFrame([(3, 1.0)], "idx long, v double"), "x"), "x", "y").collect()
    finally:
        kr.cut_lineage = old
    assert "strategy=broadcast" in plans[0]


def test_h_matrices_of_blocks_are_those_of_entries(spark):
    """Tiles of larger nodes, merged to the same blocks; absent blocks are counted with rank 0."""
    from gridloom.operators import hmatrix as hm

    n = normal.BLOCK + 100
    rng = np.random.default_rng(9)
    rows, cols = np.repeat(np.arange(400), 5), np.concatenate([rng.integers(0, 500, 1000), rng.integers(600, n, 1000)])
    a = spark.createDataFrame([(int(i), int(j), float(1 + (i + j) % 3)) for i, j in zip(rows, cols, strict=True)], "row long, col long, val double")
    dense = np.zeros((400, n))
    np.add.at(dense, (rows, cols), 1.0 + (rows + cols) % 3)
    nodes = hm.index_tree(spark, n, 40).cache()
    h = hm.from_blocks(normal.product(a, n, 1.0, 0.5), nodes, n, 40, 1e-13).cache()
    back = np.zeros((n, n))
    for r in hm.entries(h, nodes).collect():
        back[r["row"], r["col"]] = r["val"]
    assert np.allclose(back, dense.T @ dense + 0.5 * np.eye(n), atol=1e-8)
    counts = {(r["level"], r["kind"]): r["blocks"] for r in hm.leaf_counts(hm.with_absent(h, nodes, hm.weak_blocks(nodes))).collect()}
    assert counts == {(level, "lowrank"): 2**level for level in range(1, 6)} | {(5, "dense"): 32}
