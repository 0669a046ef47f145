"""Queries over readers and writers: a given table or a mesh of parts is written in a format under the shared folder, read back, and returned in full."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..session import shared_folder, table
from ..sources import files, meshes, sinks
from . import part_nodes
from .field_queries import _CUBES, cubes
from .linalg_queries import _A, matrix, n_suppliers
from .part_nodes import GRID, TRIANGLES


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _triplets(s, d):
    at = _folder(s, "triplets")
    sinks.write_triplets(matrix(s, d), at)
    return files.read_triplets(s, at)


def _vtk(s, d):
    """Suppliers as points with a vector; the written text's lines of points and of vectors, in order, with their section."""
    at = _folder(s, "vtk")
    k = F.col("s_suppkey").cast("double")
    sinks.write_vtk(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(k, k / 2, -k).alias("x"), F.array(k + 0.5, F.lit(0.0), k * 2).alias("v")), at)
    meshes.read_ordered_text(s, at, at + "-one")
    lines = s.read.text(at + "-one").select(F.monotonically_increasing_id().alias("n"), F.split("value", " ").alias("t"))
    n = n_suppliers(s, d)
    rows = lines.filter((F.size("t") == 3) & F.col("t")[0].try_cast("double").isNotNull())
    return rows.select((F.col("n") >= 5 + n).alias("is_vector"), *[F.col("t")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def _record(s, d):
    """Two runs of an experiment appended to one table."""
    at = _folder(s, "record")
    for region in (0, 1):
        sinks.append_record(table(s, d, "nation").filter(F.col("n_regionkey") == region).select("n_nationkey", "n_name"), at)
    return s.read.schema("n_nationkey int, n_name string").option("sep", ";").option("header", True).csv(at)


def _sparsity_record(s, d):
    """The sparsity constant of the parts' block tree as a record."""
    at = _folder(s, "sparsity")
    from .cluster_queries import _blocks

    sinks.append_record(cl.sparsity_constant(_blocks(s, d)), at)
    return s.read.schema("csp_r long, csp_c long, csp long").option("sep", ";").option("header", True).csv(at)


def _vector(s, d):
    at = _folder(s, "vector")
    sinks.write_vector(table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("v")), at)
    return files.read_csv_vector(s, at).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def _matrix_rows(s, d):
    at = _folder(s, "rows")
    rows = table(s, d, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("double")), F.transform("embedding", lambda e: e.cast("double"))).alias("x"))
    sinks.write_matrix_rows(rows, at, ";")
    return files.read_csv_matrix(s, at, 65, ";").select(F.col("x")[0].cast("long").alias("id"), F.posexplode(F.slice("x", 2, 64)).alias("axis", "v"))


def _tables(s, d):
    """Several tables of a computation under their names, read back and joined."""
    at = _folder(s, "tables")
    sinks.write_tables({"rows": table(s, d, "customer").select("c_custkey", "c_nationkey"), "names": table(s, d, "nation").select("n_nationkey", "n_name")}, at)
    return s.read.parquet(f"{at}/rows").join(s.read.parquet(f"{at}/names"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


def _config(s, d):
    """Each nation's key and region as a configuration in XML, read by dotted paths."""
    at = _folder(s, "config")
    values = {f"nations.n{r['n_nationkey']}.{k}": str(r[c]) for r in table(s, d, "nation").collect() for k, c in (("name", "n_name"), ("region", "n_regionkey"))}
    s.createDataFrame([(sinks.xml_of(values),)], "value string").write.text(at)
    found = files.read_xml_config(s, at)
    return s.createDataFrame(sorted(found.items()), "path string, value string")


def _clusters(s, d):
    at = _folder(s, "clusters")
    from .cluster_queries import AXES, _nodes

    meshes.write_clusters(_nodes(s, d), at)
    return meshes.read_clusters(s, at, AXES).select("node", "size", "leaf", *[f"{m}_{a}" for a in AXES for m in ("min", "max")])


def _one_text(s: SparkSession, lines: DataFrame, name: str) -> str:
    """Lines (part, id, value) as one text file's folder, in order."""
    at = _folder(s, name)
    lines.repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("value").write.text(at)
    meshes.read_ordered_text(s, at, at + "-one")
    return at + "-one"


def _words(x: str) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), " ")


def _lines(s: SparkSession, *parts: DataFrame | list[str]) -> DataFrame:
    """(part, id, value) of sections: lists of fixed lines, or frames (id, value)."""
    out = None
    for k, p in enumerate(parts):
        one = s.createDataFrame(list(enumerate(p)), "id long, value string") if isinstance(p, list) else p.select("id", "value")
        one = one.select(F.lit(k).alias("part"), "id", "value")
        out = one if out is None else out.unionByName(one)
    return out


def _mesh3(s, d):
    """The suppliers' cubes with vertices and faces numbered from 0."""
    vertices, faces = cubes(s, d)
    return vertices, faces, vertices.count(), faces.count()


def _off(s, d):
    v, f, n_v, n_f = _mesh3(s, d)
    at = _one_text(s, _lines(s, ["OFF", "# cubes", f"{n_v} {n_f} 0"], v.withColumn("value", _words("x")), f.withColumn("value", F.concat(F.lit("3 "), _words("v"), F.lit(" 255 0 "), F.col("id") % 256))), "off")
    _, faces = files.read_off(s, at)
    return faces.select("id", F.array_join("v", " ").alias("v"), F.array_join("colour", " ").alias("colour"))


def _off_vertices(s, d):
    v, f, n_v, n_f = _mesh3(s, d)
    at = _one_text(s, _lines(s, [f"OFF {n_v} {n_f} 0"], v.withColumn("value", _words("x")), f.withColumn("value", F.concat(F.lit("3 "), _words("v")))), "off")
    vertices, _ = files.read_off(s, at)
    return vertices.select("id", *[F.col("x")[i].alias(c) for i, c in enumerate("xyz")])


def _stl(s, d):
    """A binary file for each nation, with a triangle for each of its customers, made where the rows are and read as binary files."""
    at = _folder(s, "stl")

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        body = b"".join(struct.pack("<12fH", 0.0, 0.0, 1.0, float(k), 0.0, 0.0, float(k) + 1, 0.0, 0.0, 0.0, 1.0, 0.0, int(k) % 1000) for k in sorted(f["c_custkey"]))
        return pd.DataFrame({"value": [(b"\0" * 80 + struct.pack("<I", len(f)) + body).hex()], "nation": [int(f["c_nationkey"].iloc[0])]})

    packed = table(s, d, "customer").groupBy("c_nationkey").applyInPandas(pack, "value string, nation int")
    packed.write.partitionBy("nation").text(at)
    # Spark has no writer of raw bytes: the records are kept as text of hex digits and decoded by the reader's own parser.
    content = s.read.text(at).select(F.col("nation").cast("string").alias("path"), F.unhex("value").alias("content"))
    found = files.parse_stl(content)
    return found.select(F.col("file").cast("int").alias("nation"), "id", F.col("p1")[0].alias("x"), F.col("normal")[2].alias("nz"), "attribute")


def _surface(kind: str):
    """Vertices and triangles of the parts' lattice, written as `kind` and read back: its triangles."""

    def run(s, d):
        vertices, triangles = part_nodes.mesh(s, d)
        n_v, n_t = vertices.count(), triangles.count()
        flat = F.concat(_words("x"), F.lit(" 0.0"))
        if kind == "gmsh":
            at = _one_text(s, _lines(s, ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", str(n_v)], vertices.withColumn("value", F.concat((F.col("id") + 1).cast("string"), F.lit(" "), flat)), ["$EndNodes", "$Elements", str(n_t + 1), "1 15 2 0 1 1"], triangles.withColumn("w", F.transform("v", lambda v: v + 1)).withColumn("value", F.concat((F.col("id") + 2).cast("string"), F.lit(" 2 2 0 1 "), _words("w"))), ["$EndElements"]), kind)
            found = meshes.read_gmsh(s, at)
        elif kind == "netgen":
            at = _one_text(s, _lines(s, ["mesh3d", "surfaceelements", str(n_t)], triangles.withColumn("w", F.transform("v", lambda v: v + 1)).withColumn("value", F.concat(F.lit("1 1 0 0 3 "), _words("w"))), ["points", str(n_v)], vertices.withColumn("value", flat)), kind)
            found = meshes.read_netgen(s, at)
        else:
            tag = (F.col("id") + 10).cast("string")
            nodes = vertices.withColumn("value", F.explode(F.array(F.concat(tag, F.lit(" 1 1 11")), F.regexp_replace(flat, "E", "D"))))
            corner = F.transform("v", lambda v: v + 10)
            # A beam, of three lines, stands between the triangles.
            beam = s.createDataFrame([(0, "1 11 2 1 7 2"), (1, "0 1 1"), (2, "10 11")], "id long, value string")
            cells = triangles.withColumn("w", corner).select((F.col("id") * 2 + 10).alias("id"), F.explode(F.array(F.concat((F.col("id") + 2).cast("string"), F.lit(" 41 2 1 7 3")), _words("w"))).alias("value"))
            ordered = lambda df: df.withColumn("id", F.col("id") * 2 + F.when(F.size(F.split("value", " ")) > 3, 0).otherwise(1))
            nodes = nodes.withColumn("id", F.col("id") * 2 + (F.size(F.split("value", " ")) != 4).cast("int"))
            at = _one_text(s, _lines(s, ["-1", "2411"], nodes, ["-1", "-1", "2412"], beam.unionByName(ordered(cells)), ["-1"]), kind)
            found = meshes.read_unv(s, at)
        # Readers number what they read in order.
        return _by_place(found["triangles"], found["vertices"])

    return run


def _by_place(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each triangle's corner sums: what doesn't depend on how a format numbers things."""
    each = triangles.select("id", F.explode("v").alias("v")).join(vertices.select(F.col("id").alias("v"), F.col("x")[0].alias("x"), F.col("x")[1].alias("y")), "v")
    return each.groupBy("id").agg(F.round(F.sum("x"), 6).alias("x"), F.round(F.sum("y"), 6).alias("y")).select("x", "y")


_PLACES = f"WITH g AS (SELECT * FROM {GRID}) SELECT round(a.x + b.x + c.x, 6) AS x, round(a.y + b.y + c.y, 6) AS y FROM {TRIANGLES} t JOIN g a ON a.idx = t.a JOIN g b ON b.idx = t.b JOIN g c ON c.idx = t.c"


def _native_surface(s, d):
    """The native surface form with edges: triangles by vertices, and how often each edge is used."""
    at = _folder(s, "surface")
    vertices, triangles = part_nodes.mesh(s, d)
    m = part_nodes.side(s, d)
    # Vertices of the lattice are 0 to m^2 - 1; triangles are numbered anew from 0.
    cell = F.floor(F.col("id") / 2)
    dense = ((F.floor(cell / m) * (m - 1) + cell % m) * 2 + F.col("id") % 2).alias("id")
    edges, listed = meshes.with_edges(triangles.select(dense, "v"))
    meshes.write_surface({"vertices": vertices.withColumn("x", F.concat("x", F.array(F.lit(0.0)))), "edges": edges, "triangles": listed}, at)
    meshes.read_ordered_text(s, at, at + "-one")
    back = meshes.read_surface(s, at + "-one")
    used = back["triangles"].select(F.explode("e").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return back["edges"].join(used, "id").select(F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), "n")


def _native_triangles(s, d):
    at = _folder(s, "triangles")
    vertices, triangles = part_nodes.mesh(s, d)
    edges, listed = meshes.with_edges(triangles.withColumn("id", F.col("id").cast("long")))
    from ..operators.ranges import renumbered

    listed = renumbered(listed.withColumnRenamed("id", "idx")).withColumnRenamed("idx", "id")
    kinds = part_nodes.nodes(s, d).select("id", (F.col("type") < 0).cast("int").alias("boundary"))
    meshes.write_triangles({"vertices": vertices.join(kinds, "id"), "edges": edges.withColumn("boundary", F.lit(0)), "triangles": listed}, at)
    meshes.read_ordered_text(s, at, at + "-one")
    back = meshes.read_triangles(s, at + "-one")
    return back["vertices"].select("id", F.round(F.col("x")[0], 9).alias("x"), F.round(F.col("x")[1], 9).alias("y"), "boundary")


def _tetrahedra(s, d):
    """A tetrahedron for each supplier, in the native form with edges and faces: its faces' edges."""
    at = _folder(s, "tetrahedra")
    k = F.col("s_suppkey")
    each = table(s, d, "supplier").select(k.alias("k"))
    numbered = lambda n, rows, name: each.select("k", F.posexplode(F.array(*[F.array(*[F.lit(v) for v in r]) for r in rows])).alias("i", "r")).select((F.col("k") * n + F.col("i")).alias("id"), "k", F.col("r").alias(name))
    shifted = lambda df, c, by: df.withColumn(c, F.transform(c, lambda v: v + F.col("k") * by))
    vertices = numbered(4, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], "x").withColumn("boundary", F.lit(1))
    edges = shifted(numbered(6, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], "v"), "v", 4).withColumn("boundary", F.lit(1))
    faces = shifted(numbered(4, [(3, 5, 4), (1, 5, 2), (0, 4, 2), (0, 3, 1)], "e"), "e", 6).withColumn("boundary", F.lit(1))
    cells = shifted(numbered(1, [(0, 1, 2, 3)], "f"), "f", 4)
    meshes.write_tetrahedra({"vertices": vertices, "edges": edges, "faces": faces, "tetrahedra": cells}, at)
    meshes.read_ordered_text(s, at, at + "-one")
    back = meshes.read_tetrahedra(s, at + "-one")
    of = back["tetrahedra"].select("id", F.explode("f").alias("f")).join(back["faces"].select(F.col("id").alias("f"), "e"), "f").select("id", F.explode("e").alias("e")).join(back["edges"].select(F.col("id").alias("e"), "v"), "e")
    return of.select("id", F.explode("v").alias("v")).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))


def _printed(s, d):
    """The first rows and columns of lineitem's matrix as text."""
    from ..operators.linalg import block_slice

    n = n_suppliers(s, d)
    return meshes.printed(block_slice(matrix(s, d), 0, 0, table(s, d, "part").count(), n), table(s, d, "part").count(), min(n, 6), "%.1f")


def _parameters(s, d):
    """Parameters of the session's settings by nation; the setting is taken back."""
    s.conf.set("gridloom.leaf", "30")
    try:
        leaf = files.parameter(s, "leaf", 50)
    finally:
        s.conf.unset("gridloom.leaf")
    return table(s, d, "nation").select("n_nationkey", F.lit(leaf).alias("leaf"), F.lit(files.parameter(s, "leaf", 50)).alias("usual"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "triplets_round_trip": (_triplets, f"SELECT * FROM {_A}"),
    "vtk_points": (_vtk, "SELECT false AS is_vector, s_suppkey::DOUBLE AS x, s_suppkey / 2.0::DOUBLE AS y, -s_suppkey::DOUBLE AS z FROM supplier UNION ALL SELECT true, s_suppkey + 0.5, 0.0, s_suppkey * 2.0 FROM supplier"),
    "experiment_records": (_record, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 1)"),
    "csv_vector_round_trip": (_vector, "SELECT p_retailprice AS v, count(*) AS n FROM part GROUP BY 1"),
    "csv_matrix_round_trip": (_matrix_rows, "SELECT vec_id AS id, (i - 1)::INT AS axis, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)"),
    "tables_round_trip": (_tables, "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "xml_config_round_trip": (_config, "SELECT concat('nations.n', n_nationkey, '.', k) AS path, CASE k WHEN 'name' THEN n_name ELSE n_regionkey::VARCHAR END AS value FROM nation, (VALUES ('name'), ('region')) t(k)"),
    "off_faces": (
        _off,
        """SELECT k * 12 + i AS id, concat_ws(' ', k * 8 + a, k * 8 + b, k * 8 + c) AS v, concat('255 0 ', (k * 12 + i) % 256) AS colour FROM """
        + _CUBES
        + ", (VALUES (0, 0, 2, 1), (1, 0, 3, 2), (2, 4, 5, 6), (3, 4, 6, 7), (4, 0, 1, 5), (5, 0, 5, 4), (6, 2, 3, 7), (7, 2, 7, 6), (8, 1, 2, 6), (9, 1, 6, 5), (10, 0, 4, 7), (11, 0, 7, 3)) f(i, a, b, c)",
    ),
    "off_vertices": (
        _off_vertices,
        "SELECT k * 8 + i AS id, (k * 8 + a * size)::DOUBLE AS x, (b * size)::DOUBLE AS y, (c * size)::DOUBLE AS z FROM " + _CUBES + ", (VALUES (0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 1), (6, 1, 1, 1), (7, 0, 1, 1)) v(i, a, b, c)",
    ),
    "stl_triangles": (_stl, "SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS id, c_custkey::DOUBLE AS x, 1.0::DOUBLE AS nz, (c_custkey % 1000)::INT AS attribute FROM customer"),
    **{f"{kind}_surface": (_surface(kind), _PLACES) for kind in ("gmsh", "netgen", "unv")},
    "surface_mesh_round_trip": (
        _native_surface,
        f"SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS n FROM (SELECT a AS p, b AS q FROM {TRIANGLES} UNION ALL SELECT b, c FROM {TRIANGLES} UNION ALL SELECT c, a FROM {TRIANGLES}) GROUP BY 1, 2",
    ),
    "triangle_mesh_round_trip": (_native_triangles, f"SELECT idx AS id, round(x, 9) AS x, round(y, 9) AS y, (type < 0)::INT AS boundary FROM {GRID} WHERE idx < m * m"),
    "tetrahedra_round_trip": (_tetrahedra, "SELECT s_suppkey AS id, s_suppkey * 4 + i AS v, 6::BIGINT AS n FROM supplier, range(4) t(i)"),
    "matrix_printed": (
        _printed,
        f"""WITH c AS (SELECT least(count(*), 6) AS n FROM supplier), a AS (SELECT * FROM {_A})
            SELECT p_partkey AS row, string_agg(printf('%.1f', coalesce(val, 0.0)), ' ' ORDER BY j) AS line FROM part, c, range(6) t(j) LEFT JOIN a ON a.row = p_partkey AND a.col = j WHERE j < n GROUP BY p_partkey""",
    ),
    "parameters": (_parameters, "SELECT n_nationkey, 30::INT AS leaf, 50::INT AS usual FROM nation"),
}


def _with_trees() -> None:
    """Those whose SQL is the cluster queries'."""
    from .cluster_queries import QUERIES as trees

    QUERIES["clusters_round_trip"] = (_clusters, trees["cluster_tree"][1])
    QUERIES["sparsity_record"] = (_sparsity_record, trees["sparsity_constant"][1])


_with_trees()
