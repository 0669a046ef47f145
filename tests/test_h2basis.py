"""Stored H2 bases against dense matrices: orthogonalized, compressed, updated."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cluster as cl
from gridloom.operators import h2basis as hb

AXES = ["x", "y"]


@pytest.fixture(scope="module")
def built(spark):
    rng = np.random.default_rng(6)
    xy = rng.random((90, 2))
    points = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(xy)], "id long, x double, y double")
    leaves = cl.bisect(points, AXES, 8, 20)
    nodes = cl.tree(leaves, AXES).cache()
    blocks = cl.block_tree(nodes, AXES, "two_min", 2.0)
    kernel = lambda a, c: 1.0 / (1.0 + ((a[:, None] - c[None]) ** 2).sum(axis=2))
    h = hb.from_kernel(leaves.select("id", "node", F.array("x", "y").alias("x")), nodes, AXES, blocks, kernel, 4)
    return h, kernel(xy, xy), rng.random(90)


def applied(spark, h, x):
    out = np.zeros(len(x))
    for r in hb.matvec(h, spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, v double")).collect():
        out[r["idx"]] = r["v"]
    return out


def test_orthogonal_bases(spark, built):
    h, dense, x = built
    plain, q = applied(spark, h, x), hb.orthogonalized(h)
    assert np.allclose(plain, dense @ x, rtol=1e-3)
    assert np.allclose(applied(spark, q, x), plain, rtol=1e-10)
    for r in q.leaves.collect():
        v = np.frombuffer(r["v"]).reshape(len(r["ids"]), r["k"])
        assert np.allclose(v.T @ v, np.eye(r["k"]))
    sons = {}
    for r in q.transfers.collect():
        sons.setdefault(r["node"] >> 1, []).append(np.frombuffer(r["e"]).reshape(r["k"], r["kf"]))
    for parts in sons.values():
        e = np.concatenate(parts)
        assert np.allclose(e.T @ e, np.eye(e.shape[1]))


@pytest.mark.parametrize("eps", [1e-3, 1e-9])
def test_compression_keeps_the_accuracy(spark, built, eps):
    h, _, x = built
    q = hb.orthogonalized(h)
    small = hb.compressed(q, eps)
    before, after = applied(spark, q, x), applied(spark, small, x)
    assert np.linalg.norm(after - before) <= 20 * eps * np.linalg.norm(before)
    k = lambda m: hb.ranks(m).agg(F.sum("k")).first()[0]
    assert k(small) < k(q) <= k(h)
    if eps == 1e-3:
        assert k(small) < 0.6 * k(q)


def test_update(spark, built):
    h, dense, x = built
    rng = np.random.default_rng(7)
    a, b = rng.random(90), np.where(np.arange(90) % 3 == 0, rng.random(90), 0)
    table = lambda v: spark.createDataFrame([(i, float(z)) for i, z in enumerate(v) if z], "idx long, v double")
    got = hb.updated(h, table(a), table(b))
    assert np.allclose(applied(spark, got, x), applied(spark, h, x) + a * (b @ x))
    small = hb.compressed(hb.orthogonalized(got), 1e-10)
    assert np.allclose(applied(spark, small, x), applied(spark, h, x) + a * (b @ x), rtol=1e-7)


def test_one_leaf(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.5)], "id long, x double, y double")
    leaves = cl.bisect(points, AXES, 8, 5)
    nodes = cl.tree(leaves, AXES)
    h = hb.from_kernel(leaves.select("id", "node", F.array("x", "y").alias("x")), nodes, AXES, cl.block_tree(nodes, AXES, "two_min", 1.0), lambda a, c: 1.0 + a @ c.T, 2)
    small = hb.compressed(hb.orthogonalized(h), 1e-8)
    assert np.allclose(applied(spark, small, np.ones(2)), [2.0, 3.25])
