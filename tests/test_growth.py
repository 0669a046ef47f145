"""What held in small tables only: rounding at fine spacings, plans and pieces that grow with levels or rounds."""

import numpy as np


def test_operator_of_a_constant_field_is_exactly_zero(spark):
    from gridloom.operators import approx
    from gridloom.operators import spatial as sp

    rng = np.random.default_rng(3)
    x = rng.random((60, 2)) * 1e-3
    nodes = spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(x)], "id long, x array<double>")
    values = nodes.selectExpr("id", "x", "CAST(7.3 AS DOUBLE) AS v")
    ops = {"value": approx.operator("value"), "lap2": approx.bilaplacian(2)}
    found = approx.approximate(nodes, sp.knn(nodes, nodes, 40), values, ops, degree=4, k=5).collect()
    assert {(r["op"], r["v"]) for r in found} == {("value", 7.3), ("lap2", 0.0)}


def test_loops_of_joins_keep_a_sane_size_estimate_and_few_pieces(spark):
    from pyspark.sql import functions as F

    from gridloom.session import PIECES, Pieces, cut_lineage

    side = cut_lineage(spark.range(40).withColumn("w", F.lit(1.0)))
    now, pieces = spark.range(40).withColumn("v", F.lit(0.0)), Pieces()
    for _ in range(PIECES + 2):
        now = cut_lineage(now.join(side, "id").select("id", (F.col("v") + F.col("w")).alias("v")))
        pieces.add(now)
    twice = spark.range(4)
    for _ in range(11):
        twice = cut_lineage(twice.join(twice.select(F.col("id").alias("other")), F.col("id") == F.col("other")).select("id"))
    assert twice._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 4096
    assert sorted(r["id"] for r in twice.collect()) == [0, 1, 2, 3]
    assert sorted(r["v"] for r in now.collect()) == [PIECES + 2.0] * 40
    assert len(pieces.kept) == 3
    assert sorted(r["v"] for r in pieces.table().collect()) == sorted(float(v) for v in range(1, PIECES + 3) for _ in range(40))


def test_frobenius_tails_are_running_sums(spark):
    from gridloom.operators import ordered

    df = spark.createDataFrame([(0, i, float(2 ** -i)) for i in range(6)] + [(1, 0, 1.0), (1, 1, 1.0)], "key long, ord long, sigma double")
    ranks = ordered.truncation_rank(df, 0.25, frobenius=True)
    assert "unboundedfollowing" not in ranks._jdf.queryExecution().optimizedPlan().toString().lower().replace("unboundedpreceding$(), unboundedfollowing$()", "")
    assert {r["key"]: r["rank"] for r in ranks.collect()} == {0: 2, 1: 2}


def test_all_pairs_of_clusters_are_dealt_to_tasks(spark):
    from pyspark.sql import functions as F

    from gridloom.operators import cluster

    nodes = spark.range(1, 41).select(F.col("id").alias("node"))
    found = cluster.dealt_pairs(nodes, nodes)
    assert {(r["r_node"], r["c_node"]) for r in found.collect()} == {(a, b) for a in range(1, 41) for b in range(1, 41)}
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < 1000


def test_a_product_evaluates_the_kernel_once(spark):
    from gridloom.operators import lowrank

    calls = spark.sparkContext.accumulator(0)
    points = spark.createDataFrame([(i, 1, [float(i)]) for i in range(6)], "id long, node long, x array<double>")
    blocks = spark.createDataFrame([(1, 1, False, True)], "r_node long, c_node long, admissible boolean, leaf boolean")

    def kernel(a, b):
        calls.add(1)
        return a @ b.T

    ones = spark.createDataFrame([(i, 1.0) for i in range(6)], "idx long, v double")
    found = lowrank.h_matvec(lowrank.build(points, blocks, kernel, 1e-9), ones).collect()
    assert {r["idx"]: r["v"] for r in found} == {i: 15.0 * i for i in range(6)}
    assert calls.value == 1


def test_a_mesh_file_is_numbered_by_splits(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.sources import files, meshes

    body = ["$Nodes", "300", *[x for i in range(300) for x in (f"{i + 1} {i}.5 0 0", "", "# a comment")], "$EndNodes", "$Elements", "298", *[f"{i + 1} 2 2 0 1 {i + 1} {i + 2} {i + 3}" for i in range(298)], "$EndElements"]
    (tmp_path / "mesh").mkdir()
    (tmp_path / "mesh" / "one.msh").write_bytes("\r\n".join(body).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        at = str(tmp_path / "mesh")
        lines = files._lines(spark, at)
        kept = [x for x in body if x and not x.startswith("#")]
        assert [(r["n"], r["line"]) for r in lines.orderBy("n").collect()] == list(enumerate(kept))
        assert lines.filter("n >= 0").select(F.spark_partition_id()).distinct().count() > 3  # no task has them all
        found = meshes.read_gmsh(spark, at)
        assert [(r["id"], r["x"][0]) for r in found["vertices"].orderBy("id").collect()] == [(i, i + 0.5) for i in range(300)]
        assert [(r["id"], r["v"]) for r in found["triangles"].orderBy("id").collect()] == [(i, [i, i + 1, i + 2]) for i in range(298)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_oseen_momentum_keeps_its_solution_off_the_driver(spark, monkeypatch):
    from oracle import assert_same, duckdb

    from gridloom.plans import field_queries, registry

    def collected(*_):
        raise AssertionError("the solution came to the driver")

    monkeypatch.setattr(field_queries, "_oseen_solution", collected)
    d, c = "/root/testdata/sf0.001", duckdb.connect()
    c.sql(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{d}/supplier.parquet')")
    assert_same(registry.queries()["oseen_momentum"](spark, d).toPandas(), c.sql(registry.oracle_sql()["oseen_momentum"]).df())


def test_fourth_derivatives_on_a_spacing_as_of_a_million_nodes(spark):
    """a patch with the spacing and the places that 60 copies of the parts give; values as doubles are off by several tenths there."""
    from pyspark.sql import functions as F

    from gridloom.operators import approx, pde
    from gridloom.operators import spatial as sp

    h, at = 1 / 3000, np.random.default_rng(25).random((196, 2)) * 0.2
    x = np.array([0.8, 0.7]) + h * (np.stack(np.divmod(np.arange(196), 14), axis=1) + at)
    nodes = spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(x)], "id long, x array<double>").cache()
    near = sp.knn(nodes, nodes, 40).cache()
    four = approx.fine_values(nodes, lambda x: x[0] ** 4 + x[0] ** 2 * x[1] ** 2)
    assert four.filter("v_lo <> 0").count() > 150
    found = approx.approximate(nodes, near, four, {"four": approx.bilaplacian(2)}, degree=4, k=5).collect()
    assert len(found) == 196 and max(abs(r["v"] - 32) for r in found) < 0.01
    values = approx.fine_values(nodes, lambda x: x[0] ** 4 + x[0] * x[1])
    damped = pde.hyperviscous(near, values, 2, 0.5, degree=4, k=5).collect()
    assert len(damped) == 196 and max(abs(r["v"] + 12) for r in damped) < 0.01
    w = pde.weights(near, nodes, ["lap"], degree=4, k=5)
    plain = pde.apply(w, "lap", pde.apply(w, "lap", values.select(F.col("id").alias("idx"), "v"))).collect()
    assert max(abs(0.5 * r["v"] - 12) for r in plain) > 0.05
