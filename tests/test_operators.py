"""Operators against closed forms, algebraic identities and the literals of small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import mathx
from gridloom.operators import graph, linalg, lowrank, pde, ranges, solvers, spatial
from gridloom.sources import files, sinks


def dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r["row"], r["col"]] += r["val"]
    return out


def coo(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row long, col long, val double")


def spd(n=30, seed=0):
    a = np.random.default_rng(seed).standard_normal((n, n))
    return a @ a.T + n * np.eye(n)


def test_sparse_algebra_is_dense_algebra(spark):
    rng = np.random.default_rng(1)
    a, b = (np.where(rng.random((6, 6)) < 0.5, rng.integers(-4, 5, (6, 6)), 0).astype(float) for _ in range(2))
    A, B = coo(spark, a), coo(spark, b)
    assert np.array_equal(dense(linalg.spmm(A, B), 6, 6), a @ b)
    assert np.array_equal(dense(linalg.spmm(A, B, a_transposed=True), 6, 6), a.T @ b)
    assert np.array_equal(dense(linalg.add(A, B, 2.0), 6, 6), 2 * a + b)
    assert np.array_equal(dense(linalg.triangle(A, strict=True), 6, 6), np.tril(a, -1))


def test_solvers_agree_with_numpy(spark):
    a = spd()
    b = np.arange(30.0)
    x = np.linalg.solve(a, b)
    m = solvers.SparseMap(coo(spark, a), 30)
    far = solvers.SparseMap(coo(spark, a), 30, local_entries=10)
    assert np.allclose(far(b), a @ b) and np.allclose(m.transposed(b), a.T @ b)
    jacobi = lambda r: r / np.diag(a)
    for got in (solvers.cg(m, b), solvers.cg(m, b, prec=jacobi), solvers.bicg(m, m.transposed, b), solvers.bicgstab(m, b), solvers.bicgstab(m, b, prec=jacobi), solvers.gmres(m, b), solvers.gmres(m, b, restart=7)):
        assert np.allclose(got[0], x, atol=1e-7)
    assert solvers.bicgstab(m, np.zeros(30))[1] == 0
    assert np.allclose(a @ solvers.ilut(coo(spark, a), 30, 0.0, 30)(b), b)


def test_uzawa_and_block_preconditioner():
    a, d = spd(12), np.random.default_rng(2).standard_normal((4, 12))
    f, g = np.ones(12), np.arange(4.0)
    u, p, _ = solvers.uzawa(lambda r: np.linalg.solve(a, r), lambda r: d @ r, lambda r: d.T @ r, f, g)
    assert np.allclose(a @ u + d.T @ p, f) and np.allclose(d @ u, g)
    s = -d @ np.linalg.solve(a, d.T)
    prec = solvers.block_preconditioner(lambda r: np.linalg.solve(a, r), lambda r: np.linalg.solve(s, r), lambda r: d @ r, 12)
    whole = np.block([[a, d.T], [d, np.zeros((4, 4))]])
    x, steps = solvers.bicgstab(lambda r: whole @ r, np.concatenate([f, g]), prec=prec)
    assert np.allclose(whole @ x, np.concatenate([f, g])) and steps < 6


def test_eigensolvers():
    a = spd(60, 3)
    low = np.linalg.eigvalsh(a)
    assert np.allclose(solvers.lanczos(lambda x: a @ x, 60, 4)[0], low[::-1][:4])
    assert np.allclose(solvers.shift_invert(lambda x: np.linalg.solve(a, x), 0.0, 60, 3)[0], low[:3])
    assert np.allclose(solvers.lobpcg(lambda x: a @ x, 60, 3, lambda r: np.linalg.solve(a, r))[0], low[:3])
    d = np.diag(np.arange(1.0, 61)) + 0.01 * (a - a.mean())
    d = (d + d.T) / 2
    assert np.allclose(solvers.davidson(lambda x: d @ x, np.diag(d).copy(), 3)[0], np.linalg.eigvalsh(d)[::-1][:3])
    g = np.random.default_rng(4).standard_normal((50, 50))
    want = np.linalg.eigvals(g)
    got = solvers.arnoldi(lambda x: g @ x, 50, 4)[0]
    assert np.allclose(np.sort(abs(got)), np.sort(np.sort(abs(want))[::-1][:4]), rtol=1e-6)
    m = np.random.default_rng(5).standard_normal((20, 40))
    u, s, v = solvers.partial_svd(lambda x: m @ x, lambda x: m.T @ x, 20, 40, 3)
    assert np.allclose(s, np.linalg.svd(m)[1][:3]) and np.allclose(m @ v, u * s)


def test_dense_factorizations():
    a = spd(8)
    low, up = solvers.lu(a)
    assert np.allclose(low @ up, a)
    low, diagonal = solvers.ldlt(a)
    assert np.allclose(low @ np.diag(diagonal) @ low.T, a)
    b = np.arange(8.0)
    for lower in (True, False):
        t = np.tril(a) if lower else np.triu(a)
        for transposed in (True, False):
            assert np.allclose((t.T if transposed else t) @ solvers.triangular(t, b, lower, transposed), b)


def test_low_rank():
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((20, 5)), rng.standard_normal((15, 5))
    u, v = lowrank.truncate(np.column_stack([a, a]), np.column_stack([b, b]), 1e-10)
    assert u.shape[1] == 5 and np.allclose(u @ v.T, 2 * a @ b.T)
    m = a @ b.T
    for got in (lowrank.cross_approximation(lambda i: m[i], lambda j: m[:, j], 20, 15, 1e-12), lowrank.randomized(lambda x: m @ x, lambda x: m.T @ x, 15, 1e-10)):
        assert np.allclose(got[0] @ got[1].T, m)
    s = np.array([4.0, 2.0, 1.0])
    assert lowrank.rank_for(s, 0.5) == 1 and lowrank.rank_for(s, 0.5, frobenius=True) == 1 and lowrank.rank_for(np.zeros(0), 0.5) == 0


def test_kd_tree_literals(spark):
    """Ties and squared distances as nearest-neighbour lists have them."""
    pts = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0])], "id long, x array<double>")
    got = {(r["id"], r["ord"]): (r["nbr"], r["d2"]) for r in spatial.knn(pts, pts, 3, block=2).collect()}
    assert got[0, 0] == (0, 0.0) and got[0, 1] == (1, 1.0) and got[0, 2] == (3, 1.0) and got[3, 0] == (1, 0.0)
    lists = spatial.force_self(spatial.knn(pts, pts, 2, block=2), 2)
    assert all(r["nbr"] == r["id"] for r in lists.filter("ord = 0").collect())
    strict = {r["id"]: r["found"] for r in spatial.exists_in_sphere(pts.filter("id < 3"), pts.filter("id < 3"), 1.0).collect()}
    loose = {r["id"]: r["found"] for r in spatial.exists_in_sphere(pts.filter("id < 3"), pts.filter("id < 3"), 1.0, strict=False).collect()}
    assert strict == {0: False, 1: False, 2: False} and loose == {0: True, 1: True, 2: False}


def test_poisson_disk_keeps_distance(spark):
    rng = np.random.default_rng(7)
    x = rng.random((200, 2))
    pts = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>")
    kept = sorted(r["id"] for r in spatial.poisson_disk_subset(pts, 0.01, 0.1).collect())
    d = ((x[kept][:, None] - x[kept][None]) ** 2).sum(axis=2) + np.eye(len(kept))
    assert d.min() >= 0.01
    assert all((((x[i] - x[kept]) ** 2).sum(axis=1) < 0.01).any() for i in range(200) if i not in kept)


def test_graph_partition(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "src long, dst long, w double")
    v = spark.range(10)
    sides = {r["id"]: r["side"] for r in graph.two_front_partition(e, v).collect()}
    assert len(sides) == 10 and sides[9] == 0 and sides[0] == 1
    both = graph.symmetric(e)
    part = v.select("id", (F.col("id") >= 5).cast("int").alias("side"))
    assert [r["id"] for r in graph.simple_separator(both, part).collect()] == [4]
    near = graph.n_nearest(both, 3, 3, flagged=spark.range(4, 10)).collect()
    assert [(r["id"], r["dist"]) for r in near] == [(4, 1.0), (5, 2.0), (6, 3.0)]


def test_operators_reproduce_polynomials(spark):
    nodes = pde.box_nodes(spark, [0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [4, 4, 4])
    w = pde.weights(spatial.knn(nodes, nodes, 25), nodes, ["lap", "d0", "d1", "d2", "d01"])
    field = nodes.select(F.col("id").alias("idx"), (F.col("x")[0] * F.col("x")[1] + F.col("x")[2] ** 2).alias("v"))
    assert all(abs(r["v"] - 2) < 1e-6 for r in pde.apply(w, "lap", field).collect())
    assert all(abs(r["v"] - 1) < 1e-6 for r in pde.apply(w, "d01", field).collect())
    rotating = nodes.select(F.col("id").alias("idx"), F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), c.alias("v")) for i, c in enumerate((-F.col("x")[1], F.col("x")[0], F.lit(0.0)))])).alias("f")).select("idx", "f.*")
    assert all(abs(r["v"] - 2 * (r["axis"] == 2)) < 1e-6 for r in pde.curl(w, rotating).collect())
    assert all(abs(r["v"]) < 1e-6 for r in pde.divergence(w, rotating).collect())
    wls = pde.weights(spatial.knn(nodes, nodes, 25), nodes, ["lap"], method="wls")
    assert all(abs(r["v"] - 2) < 1e-6 for r in pde.apply(wls, "lap", field).collect())
    with pytest.raises(ValueError):
        pde.wls_stencil(np.zeros((3, 2)), ["lap"], 2)


@pytest.mark.parametrize("method,order", [("euler", 1), ("midpoint", 2), ("rk3", 3), ("rk4", 4), ("rk38", 4), ("fehlberg5", 5)])
def test_integrators_have_their_order(method, order):
    error = [abs(pde.runge_kutta(lambda t, y: y * np.cos(t), np.array([1.0]), 0, 2, n, method)[0] - np.exp(np.sin(2))) for n in (20, 40)]
    assert np.log2(error[0] / error[1]) > order - 0.4


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_adams_bashforth_has_its_order(order):
    error = [abs(pde.adams_bashforth(lambda t, y: -y, np.array([1.0]), 0, 1, n, order)[0] - np.exp(-1)) for n in (40, 80)]
    assert np.log2(error[0] / error[1]) > min(order, 5) - 0.5


def test_shapes(spark):
    pts = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.5, 0.5]), (2, [0.1, 0.95])], "id long, x array<double>")
    inside = lambda c: [r["id"] for r in pts.filter(c).orderBy("id").collect()]
    assert inside(pde.in_box(F.col("x"), [0, 0], [1, 1], 0.2)) == [0]
    assert inside(pde.in_ball(F.col("x"), [0.5, 0.5], 0.4)) == [0]
    assert inside(pde.in_polygon(F.col("x"), [(0, 0), (1, 0), (1, 1), (0, 1)])) == [0, 2]


def test_scalar_functions():
    assert abs(mathx.bisection(lambda x: x * x, 0, 2, 2.0) - 2**0.5) < 1e-9
    assert abs(mathx.bisection(lambda x: -x, 0, 2, -1.0) - 1) < 1e-9
    assert mathx.de_boor(0.5, [0, 0, 0, 1, 1, 1], [[0.0], [1.0], [0.0]], 2) == [0.5]
    x, y = mathx.nurbs(0.5, [0, 0, 0, 1, 1, 1], [[1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], [1.0, 0.5**0.5, 1.0], 2)
    assert abs(x * x + y * y - 1) < 1e-12
    nodes, weights = mathx.gauss_legendre(3, 0, 1)
    assert abs(sum(w * n**5 for n, w in zip(nodes, weights, strict=True)) - 1 / 6) < 1e-12


def test_files(spark, tmp_path):
    (tmp_path / "t.off").write_text("OFF\n4 4 0\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n3 0 1 2 255 0 0\n3 0 3 1 255 0 0\n3 0 2 3 0 255 0\n3 1 3 2 0 0 255\n")
    v, f = files.read_off(spark, str(tmp_path / "t.off"))
    assert v.count() == 4 and f.orderBy("id").first()["colour"] == [255, 0, 0]
    edges = files.face_edges(f).groupBy("a", "b").agg(F.sum("sign").alias("s"), F.count("*").alias("n")).collect()
    assert len(edges) == 6 and all(r["s"] == 0 and r["n"] == 2 for r in edges)
    (tmp_path / "t.stl").write_bytes(bytes(80) + (1).to_bytes(4, "little") + np.arange(12, dtype="<f4").tobytes() + (7).to_bytes(2, "little"))
    t = files.read_stl(spark, str(tmp_path / "t.stl")).first()
    assert t["p3"] == [9.0, 10.0, 11.0] and t["attribute"] == 7
    (tmp_path / "m.csv").write_text("1,2\n3,-4.5\n")
    assert [r["x"] for r in files.read_csv_matrix(spark, str(tmp_path / "m.csv"), 2).collect()] == [[1.0, 2.0], [3.0, -4.5]]
    for bad in ("1,2\n3\n", "1,2\n3,-x3.4\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            files.read_csv_matrix(spark, str(tmp_path / "bad.csv"), 2).collect()
    (tmp_path / "c.xml").write_text('<params h="0.1"><mls m="3"><abc>x</abc></mls></params>')
    assert files.read_xml_config(spark, str(tmp_path / "c.xml")) == {"h": "0.1", "mls.m": "3", "mls.abc": "x"}


def test_sinks(spark, tmp_path):
    a = coo(spark, np.array([[0.1, 0.0], [2.5, 1 / 3]]))
    sinks.write_triplets(a, str(tmp_path / "a"))
    assert np.array_equal(dense(files.read_triplets(spark, str(tmp_path / "a")), 2, 2), [[0.1, 0.0], [2.5, 1 / 3]])
    pts = spark.createDataFrame([(i, [float(i), 0.0, 0.0], [0.0, 1.0, 0.0]) for i in range(5)], "id long, x array<double>, v array<double>")
    sinks.write_vtk(pts, str(tmp_path / "p"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*"))).splitlines()
    assert text[4] == "POINTS 5 double" and text[10] == "POINT_DATA 5" and len(text) == 17
    assert '<a b="1" />' in sinks.xml_of({"a.b": "1"})


def test_streams(spark, tmp_path):
    from gridloom.streaming import incremental

    (tmp_path / "in").mkdir()
    changes = [(1, [0.0], "insert"), (2, [1.0], "insert")], [(1, [0.0], "remove"), (3, [2.0], "insert")]
    for i, rows in enumerate(changes):
        spark.createDataFrame(rows, "id long, x array<double>, op string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, x array<double>, op string").json(str(tmp_path / "in"))
        incremental.log_changes(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
        assert i == 0 or sorted(r["id"] for r in incremental.current_points(spark.read.parquet(str(tmp_path / "log"))).collect()) == [2, 3]


def test_positions(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(100)], "idx long, v long")
    got = ranges.remove(df, spark.createDataFrame([(0,), (50,)], "idx long")).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(98)) and got[0]["v"] == 10
    assert [r["v"] for r in ranges.renumbered(df.filter("idx % 3 = 0"), width=7).orderBy("idx").collect()] == [i * 10 for i in range(0, 100, 3)]


def test_minimum_separator_is_least(spark):
    from gridloom.operators import domains

    rng = np.random.default_rng(3)
    for _ in range(3):
        pairs = {(int(a), 100 + int(b)) for a, b in zip(rng.integers(0, 8, 14), rng.integers(0, 8, 14), strict=True)}
        e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
        sides = spark.createDataFrame([(i, 0) for i in range(8)] + [(100 + i, 1) for i in range(8)], "id long, side int")
        cover = {r["id"] for r in domains.minimum_separator(e, sides).collect()}
        assert all(a in cover or b in cover for a, b in pairs)
        least = min((bin(m).count("1") + len({b for a, b in pairs if not m >> a & 1}) for m in range(256)))
        assert len(cover) == least


def test_whole_cluster_trees(spark):
    """Against recursion, on a table whose tree is deeper than three levels."""
    from gridloom.plans import cluster_queries, registry

    d = "/root/testdata/sf0.01"
    q = registry.queries()
    p = np.array([(r["x"], r["y"]) for r in cluster_queries.points(spark, d).collect()])
    tree = {}

    def split(node, x):
        lo, hi = x.min(axis=0), x.max(axis=0)
        k = int((hi - lo).argmax())
        leaf = len(x) <= 50 or (hi - lo)[k] <= 0
        tree[node] = (len(x), leaf, lo, hi)
        if not leaf:
            right = x[:, k] >= (hi[k] + lo[k]) * 0.5
            split(2 * node, x[~right])
            split(2 * node + 1, x[right])

    split(1, p)
    assert {r["node"]: (r["size"], r["leaf"]) for r in q["cluster_tree_whole"](spark, d).collect()} == {k: v[:2] for k, v in tree.items()}
    depth = max(tree).bit_length() - 1
    stats = q["tree_depth_whole"](spark, d).first()
    assert stats["depth"] == depth > 3 and stats["max_leaf"] <= 50

    def gap2(a, b):
        return (np.maximum(0, np.maximum(tree[a][2] - tree[b][3], tree[b][2] - tree[a][3])) ** 2).sum()

    diameter2 = {k: ((v[3] - v[2]) ** 2).sum() for k, v in tree.items()}
    blocks = {}

    def pair(a, b):
        admissible = min(diameter2[a], diameter2[b]) <= gap2(a, b)
        blocks[a, b] = leaf = admissible or tree[a][1] or tree[b][1]
        if not leaf:
            for i in (0, 1):
                for j in (0, 1):
                    pair(2 * a + i, 2 * b + j)

    pair(1, 1)
    assert {(r["r_node"], r["c_node"]): r["leaf"] for r in q["block_tree_whole"](spark, d).collect()} == blocks
    rows = [a for (a, _), leaf in blocks.items() if leaf]
    assert q["sparsity_constant_whole"](spark, d).first()["csp_r"] == max(rows.count(a) for a in set(rows))
    leaves = [k for k, v in tree.items() if v[1]]
    want = {(a, b) for a in leaves for b in leaves if gap2(a, b) > 0}
    assert {(r["r_node"], r["c_node"]) for r in q["admissible_pairs_distant_whole"](spark, d).collect()} == want


def test_graph_queries_over_all_edges(spark):
    from gridloom.plans import graph_queries, registry

    d = "/root/testdata/sf0.001"
    pairs = [(r["src"], r["dst"]) for r in graph_queries.edges(spark, d).collect()]
    up = {i: i for p in pairs for i in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["id"]: r["component"] for r in registry.queries()["connected_components_all_edges"](spark, d).collect()}
    assert got == {i: find(i) for i in up}
    side = {i: 0 if i % 5 < 2 else 1 for i in up}
    larger = 1 if sum(v == 0 for v in side.values()) < sum(side.values()) else 0
    got = [r["id"] for r in registry.queries()["simple_separator_all_edges"](spark, d).collect()]
    assert sorted(got) == sorted({a for a, b in pairs if side[a] == larger != side[b]})


def test_minimum_separator_never_turns_into_another(spark):
    from gridloom.operators import domains

    e = spark.createDataFrame([(0, 100 + i, 1.0) for i in range(5)], "src long, dst long, w double")
    sides = spark.createDataFrame([(0, 0)] + [(100 + i, 1) for i in range(5)], "id long, side int")
    assert [r["id"] for r in domains.minimum_separator(e, sides, 5).collect()] == [0]
    with pytest.raises(ValueError, match="more than 4 edges"):
        domains.minimum_separator(e, sides, 4)


def test_minimum_separator_queries_take_all_edges(spark):
    from gridloom.plans import graph_queries, registry

    d = "/root/testdata/sf0.001"
    found = {r["id"] for r in registry.queries()["minimum_separator_vertices"](spark, d).collect()}
    cut = [(r["src"], r["dst"]) for r in graph_queries.edges(spark, d).collect() if r["src"] % 5 < 2 <= r["dst"] % 5]
    mate, near = {}, {}
    for a, b in cut:
        near.setdefault(a, []).append(b)

    def matched(u, seen):
        for v in near[u]:
            if v not in seen:
                seen.add(v)
                if v not in mate or matched(mate[v], seen):
                    mate[v] = u
                    return True
        return False

    assert len(found) == sum(matched(u, set()) for u in near)
    assert all(a in found or b in found for a, b in cut)


def test_dissection_separates(spark):
    from gridloom.operators import domains

    n = 12
    points = spark.range(n * n).select("id", F.floor(F.col("id") / n).cast("double").alias("a"), (F.col("id") % n).cast("double").alias("b"))
    at = lambda i, j: i * n + j
    e = [(at(i, j), at(k, m), 1.0) for i in range(n) for j in range(n) for k, m in ((i + 1, j), (i, j + 1), (i - 1, j), (i, j - 1)) if 0 <= k < n and 0 <= m < n]
    got = {r["id"]: (r["node"], r["separator"]) for r in domains.nested_dissection(points, spark.createDataFrame(e, "src long, dst long, w double"), ["a", "b"], 2, 10).collect()}
    assert len(got) == n * n
    up = lambda x, y: x == y or any(x >> k == y or y >> k == x for k in range(1, 8))
    assert all(up(got[s][0], got[t][0]) for s, t, _ in e if not got[s][1] and not got[t][1])
    assert all(up(got[s][0], got[t][0]) for s, t, _ in e)


def test_relaxation_spreads_nodes(spark):
    from gridloom.operators import domains

    rng = np.random.default_rng(5)
    rows = [(i, p.tolist(), 1) for i, p in enumerate(rng.random((60, 2)))]
    nodes = spark.createDataFrame(rows, "id long, x array<double>, type int")
    moved = domains.relax(nodes, 4, 4, 0.3, pde.in_box(F.col("x"), [0, 0], [1, 1]))
    before, after = (spatial.spacing(n.select("id", "x")).first()["min_dist"] for n in (nodes, moved))
    x = np.array([r["x"] for r in moved.collect()])
    assert after > before and x.min() > 0 and x.max() < 1


def test_refinement_adds_middles(spark):
    from gridloom.operators import domains

    nodes = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0])], "id long, x array<double>")
    got = domains.refine(nodes, F.col("x")[0] < 2, 1, 0.4, 10).collect()
    assert [(r["id"], r["x"]) for r in got] == [(10, [0.5, 0.0])]


def test_volume_of_a_tetrahedron(spark):
    from gridloom.operators import domains

    v = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "id long, x array<double>")
    f = spark.createDataFrame([(0, [0, 2, 1]), (1, [0, 1, 3]), (2, [0, 3, 2]), (3, [1, 2, 3])], "id long, v array<long>")
    r = domains.polyhedron_volume_moments(v, f).first()
    assert abs(r["volume"] - 1 / 6) < 1e-12 and all(abs(r[f"m{d}"] - 1 / 24) < 1e-12 for d in range(3))


def test_h_matrix_arithmetic(spark):
    from gridloom.operators import cluster

    x = np.linspace(0, 1, 120)
    pts = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, a double")
    b = cluster.bisect(pts, ["a"], 16, 6)
    blocks = cluster.block_tree(cluster.tree(b, ["a"]), ["a"], "two_min", 1.0)
    kernel = lambda p, q: 1.0 / (0.1 + np.abs(p[:, None, 0] - q[None, :, 0]))
    h = lowrank.build(b.select("id", "node", F.array("a").alias("x")), blocks, kernel, 1e-10)
    dense_h = kernel(x[:, None], x[:, None])
    v = np.cos(np.arange(120.0))
    vec = spark.createDataFrame([(i, float(c)) for i, c in enumerate(v)], "idx long, v double")
    for m, factor in ((h, 1.0), (lowrank.add(h, h, 1e-10), 2.0), (lowrank.scale(h, -3.0), -3.0), (lowrank.recompress(h, 1e-9), 1.0)):
        got = {r["idx"]: r["v"] for r in lowrank.h_matvec(m, vec).collect()}
        assert np.allclose([got[i] for i in range(120)], factor * dense_h @ v, atol=1e-5)
    s = lowrank.storage(h).first()
    assert s["max_rank"] < 16 and s["dense_bytes"] + s["lowrank_bytes"] < 8 * 120 * 120


def test_components_give_each_id_once(spark):
    """A hub, a chain, repeated edges in both directions, a loop, and no edges at all."""
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(201, 200), (200, 201), (200, 201), (7, 7)]
    want = dict.fromkeys(range(60), 0) | dict.fromkeys(range(100, 121), 100) | {200: 200, 201: 200}
    got = graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted((r["id"], r["component"]) for r in got) == sorted(want.items())
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
