"""Advancing fronts and nearest vertices by path against plain passes."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fronts as fr
from gridloom.operators import graph as gr


def _points(spark, rows):
    return spark.createDataFrame(rows, "id long, x array<double>, reach double")


def test_settled_is_a_pass_in_order(spark):
    rng = np.random.default_rng(3)
    xy, reach = rng.random((300, 2)), rng.choice([0.03, 0.05, 0.2], 300)
    xy[50] = xy[40]
    rows = [(int(i), [float(v) for v in xy[i]], float(reach[i])) for i in range(300)]
    kept = []
    for i, _, r in rows:
        if all(np.linalg.norm(xy[i] - xy[k]) >= r for k in kept):
            kept.append(i)
    assert sorted(r["id"] for r in fr.settled(_points(spark, rows), 2).collect()) == kept
    pairs = {(r["id"], r["nbr"]) for r in fr.within_reach(_points(spark, rows), _points(spark, rows), 2).collect()}
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(d < reach[:, None]), strict=True)}


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_fill_of_variable_density(spark, dim):
    """No two nodes nearer than the spacing at either, no point of the domain far from all, and the same nodes when run again."""
    h = [0.06, 0.15, 0.3][dim - 1]
    spacing = lambda x: h * (1 + x[0])
    inside = lambda x: F.forall(x, lambda v: (v >= 0) & (v <= 1))
    seeds = spark.createDataFrame([(1, [0.1] * dim), (2, [0.1 + 3 * h] + [0.1] * (dim - 1))], "id long, x array<double>")
    run = lambda: fr.fill(seeds, spacing, inside, dim, samples=15 if dim < 3 else 40).toPandas()
    got = run()
    x = np.array(got["x"].tolist())
    assert got["id"].is_unique and (x >= 0).all() and (x <= 1).all()
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + 9 * np.eye(len(x))
    # A candidate keeps its origin's spacing, and the origin is one spacing away: h at the node is at most 1 + h times that.
    own = h * (1 + x[:, 0])
    assert (d >= np.minimum(own[:, None], own[None]) / (1 + h) - 1e-9).all()
    probes = np.random.default_rng(4).random((2000, dim))
    near = np.linalg.norm(probes[:, None] - x[None], axis=2).min(axis=1)
    assert (near <= 1.3 * h * (1 + probes[:, 0])).all()
    if dim == 2:
        again = run().sort_values("id")
        assert again["x"].tolist() == got.sort_values("id")["x"].tolist()


def test_fill_odd_cases(spark):
    none = spark.createDataFrame([], "id long, x array<double>")
    inside = lambda x: F.abs(x[0]) <= 1
    assert fr.fill(none, lambda x: F.lit(0.1), inside, 2).count() == 0
    alone = spark.createDataFrame([(1, [5.0, 5.0]), (1, [5.0, 5.0])], "id long, x array<double>")
    assert fr.fill(alone, lambda x: F.lit(0.1), inside, 2).count() == 1
    with pytest.raises(Exception, match="spacing must be positive"):
        fr.fill(alone, lambda x: F.lit(0.0), lambda x: F.lit(True), 2).count()
    with pytest.raises(RuntimeError):
        fr.fill(alone, lambda x: F.lit(0.1), lambda x: F.lit(True), 1, most_generations=2)
    with pytest.raises(ValueError):
        fr.fill(alone, lambda x: F.lit(0.1), inside, 2, tolerance=1.0)


def test_nearest_by_path(spark):
    """Against Dijkstra from each source; a hub with many edges, ties, loops, repeated edges and a part of its own."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(1, 5, 150), strict=True)]
    edges += [(0, i, 2.0) for i in range(1, 60)] + [(i, 0, 3.0) for i in range(1, 60)] + [(70, 71, 1.0), (71, 70, 1.0), edges[0]]
    best = {}
    for a, b, w in edges:
        if a != b:
            best.setdefault(a, {})[b] = min(w, best.get(a, {}).get(b, math.inf))

    def plain(source, n):
        heap, done = [(0.0, source)], []
        seen = {}
        while heap:
            dist, v = heapq.heappop(heap)
            if v in seen:
                continue
            seen[v] = dist
            done.append((dist, v))
            for b, w in best.get(v, {}).items():
                heapq.heappush(heap, (dist + w, b))
        return sorted(done)[:n]

    table = spark.createDataFrame(edges, "src long, dst long, w double")
    sources = spark.createDataFrame([(v,) for v in [*range(60), 70, 99, 99]], "id long")
    for n in (1, 7):
        got = gr.nearest_by_path(table, sources, n).orderBy("source", "rank").collect()
        for s in [*range(60), 70, 99]:
            assert [(r["dist"], r["id"]) for r in got if r["source"] == s] == plain(s, n), s
    with pytest.raises(Exception, match="positive"):
        gr.nearest_by_path(spark.createDataFrame([(1, 2, 0.0)], "src long, dst long, w double"), sources, 3)
    with pytest.raises(ValueError):
        gr.nearest_by_path(table, sources, 0)
