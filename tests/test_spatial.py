"""Neighbour joins against plain loops, also far from the origin."""

import numpy as np
import pytest

from gridloom.operators import spatial as sp

LITERALS = [(2.9, 3.4, 0.1), (3.2, 2.1, 0.9), (0.5, 3.7, 2.2), (1.5, 1.5, 3.5), (4.4, 0.2, 3.1), (0.1, 0.2, 0.3), (3.8, 4.1, 2.0), (2.2, 0.9, 0.4), (1.1, 2.4, 2.6), (4.9, 4.8, 0.7)]


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "id long, x array<double>").repartition(3)


def distances(a, b):
    return [[sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) for y in b] for x in a]


@pytest.mark.parametrize("shift", [0.0, 1e6, -1e9])
@pytest.mark.parametrize("dim", [2, 3, 7])
@pytest.mark.parametrize("block", [3, 4096])
def test_far_from_the_origin(spark, shift, dim, block):
    rng = np.random.default_rng(dim)
    rows = (np.round(rng.random((23, dim)) * 8) / 1024 + shift).tolist()  # with ties, and exact at every shift
    rows += [rows[0], rows[0]]
    d2 = distances(rows, rows)
    df = frame(spark, rows)
    got = sorted((r["id"], r["ord"], r["nbr"], r["d2"]) for r in sp.knn(df, df, 4, block).collect())
    assert got == sorted((i, o, j, d) for i, row in enumerate(d2) for o, (d, j) in enumerate(sorted((d, j) for j, d in enumerate(row))[:4]))
    r2 = sorted(d2[3])[6]
    assert sorted((r["id"], r["nbr"], r["d2"]) for r in sp.radius_join(df, df, r2, block).collect()) == sorted((i, j, d) for i, row in enumerate(d2) for j, d in enumerate(row) if d < r2)
    for strict in (True, False):
        found = {r["id"]: r["found"] for r in sp.exists_in_sphere(df, df, r2, strict, block).collect()}
        assert found == {i: any(j != i and (d < r2 or (d == r2 and not strict)) for j, d in enumerate(row)) for i, row in enumerate(d2)}


def test_close_points_are_told_apart(spark):
    rows = [(1e6 + 0.001 * k, 1e6) for k in range(5)]
    df = frame(spark, rows)
    assert {(r["id"], r["nbr"]) for r in sp.knn(df, df, 1).collect()} == {(k, k) for k in range(5)}
    assert sp.radius_join(df, df, 0.0015**2).count() == 13


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_literal_points(spark, shift):
    points = [tuple(v + shift for v in x) for x in LITERALS]
    df = frame(spark, points)
    asked = frame(spark, [tuple(v + shift for v in x) for x in ((4.1, 3, 0.5), (2, 2, 3))])
    got = sorted((r["id"], r["ord"], r["nbr"]) for r in sp.knn(asked, df, 3).collect())
    want = distances([(4.1, 3, 0.5), (2, 2, 3)], LITERALS)
    assert got == [(i, o, j) for i, row in enumerate(want) for o, (_, j) in enumerate(sorted((d, j) for j, d in enumerate(row))[:3])]


def test_tasks_are_dealt_squares_of_blocks(spark):
    """rows are sent once for each square along the other side, not for each block there."""
    rng = np.random.default_rng(5)
    rows = np.round(rng.random((400, 6)) * 64).tolist()
    df = frame(spark, rows)
    d2 = distances(rows, rows)
    joined = sp.radius_join(df, df, 900.0, 4)
    sent = [n for n in joined._jdf.queryExecution().analyzed().toString().split("sequence(0, ")[1:]]
    assert len(sent) == 2 and all(int(n.split(",")[0]) < 30 for n in sent)
    assert sorted((r["id"], r["nbr"], r["d2"]) for r in joined.collect()) == sorted((i, j, d) for i, row in enumerate(d2) for j, d in enumerate(row) if d < 900)
    got = sorted((r["id"], r["ord"], r["nbr"], r["d2"]) for r in sp.knn(df, df, 3, 4).collect())
    assert got == sorted((i, o, j, d) for i, row in enumerate(d2) for o, (d, j) in enumerate(sorted((d, j) for j, d in enumerate(row))[:3]))
