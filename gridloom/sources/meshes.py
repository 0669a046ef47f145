"""Mesh files: native text meshes of triangles and tetrahedra, surface meshes of mesh generators, and writers.

A file's header says how to read the rest, so its lines are numbered; sections are then
plain filters and projections of its lines. A mesh is tables of its parts, each with an
id from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import renumbered
from ..session import cut_lineage
from .files import _lines


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, t): the words of each line that isn't blank or a comment, from 0."""
    lines = _lines(spark, path).withColumn("line", F.trim(F.regexp_replace("line", r"\s+#.*$", "")))
    return lines.select("n", "line", F.split("line", r"\s+").alias("t"))


def _whole(at: int, n: int) -> Column:
    return F.transform(F.slice("t", at, n), lambda c: c.try_cast("long"))


def _real(at: int, n: int) -> Column:
    return F.transform(F.slice("t", at, n), lambda c: c.try_cast("double"))


def _sections(lines: DataFrame, first: int, counts: list[int]) -> list[DataFrame]:
    out = []
    for n in counts:
        out.append(lines.filter(F.col("n").between(first, first + n - 1)).withColumn("id", (F.col("n") - first).cast("long")))
        first += n
    return out


def _counts(lines: DataFrame, path: str, parts: int) -> list[int]:
    head = lines.filter("n = 0").first()
    if head is None or len(head["t"]) < parts or not all(x.isdigit() for x in head["t"][:parts]):
        raise ValueError(f"{path} doesn't begin with {parts} counts")
    counts = [int(x) for x in head["t"][:parts]]
    if lines.count() < 1 + sum(counts):
        raise ValueError(f"{path} ends before its {sum(counts)} parts")
    return counts


def read_surface(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """vertices(id, x), edges(id, v) and triangles(id, v, e) of a surface mesh in native text form."""
    lines = _numbered(spark, path)
    v, e, t = _sections(lines, 1, _counts(lines, path, 3))
    return {"vertices": v.select("id", _real(1, 3).alias("x")), "edges": e.select("id", _whole(1, 2).alias("v")), "triangles": t.select("id", _whole(1, 3).alias("v"), _whole(4, 3).alias("e"))}


def read_triangles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """vertices(id, x, boundary), edges(id, v, boundary) and triangles(id, e) of a plane mesh."""
    lines = _numbered(spark, path)
    v, e, t = _sections(lines, 1, _counts(lines, path, 3))
    flag = lambda at: F.expr(f"try_cast(get(t, {at - 1}) AS INT)").alias("boundary")
    return {"vertices": v.select("id", _real(1, 2).alias("x"), flag(3)), "edges": e.select("id", _whole(1, 2).alias("v"), flag(3)), "triangles": t.select("id", _whole(1, 3).alias("e"))}


def read_tetrahedra(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """vertices(id, x, boundary), edges(id, v, boundary), faces(id, e, boundary) and tetrahedra(id, f)."""
    lines = _numbered(spark, path)
    v, e, f, t = _sections(lines, 1, _counts(lines, path, 4))
    flag = lambda at: F.expr(f"try_cast(get(t, {at - 1}) AS INT)").alias("boundary")
    return {
        "vertices": v.select("id", _real(1, 3).alias("x"), flag(4)),
        "edges": e.select("id", _whole(1, 2).alias("v"), flag(3)),
        "faces": f.select("id", _whole(1, 3).alias("e"), flag(4)),
        "tetrahedra": t.select("id", _whole(1, 4).alias("f")),
    }


def _after(lines: DataFrame, name: str, ends: str | None = None) -> DataFrame:
    """The lines after the one that says `name`, up to the one that says `ends`."""
    found = lines.filter(F.col("line") == name).agg(F.min("n")).first()[0]
    if found is None:
        raise ValueError(f"there is no section {name}")
    rest = lines.filter(F.col("n") > found)
    if ends is not None:
        stop = rest.filter(F.col("line") == ends).agg(F.min("n")).first()[0]
        rest = rest if stop is None else rest.filter(F.col("n") < stop)
    return rest


def _listed(rows: DataFrame) -> DataFrame:
    # Written, as strict casts of what a line should hold mustn't be moved before the filters that choose it.
    return cut_lineage(renumbered(rows.withColumn("id", F.col("n")), "id"))


def read_gmsh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """vertices(id, x) and triangles(id, v) of a Gmsh text file, version 2: elements of type 2; their tags are skipped."""
    lines = _numbered(spark, path)
    nodes = _after(lines, "$Nodes", "$EndNodes").filter(F.size("t") >= 4)
    vertices = _listed(nodes).select("id", _real(2, 3).alias("x"), F.col("t")[0].cast("long").alias("_tag"))
    elements = _after(lines, "$Elements", "$EndElements").filter((F.size("t") > 3) & (F.expr("get(t, 1)") == "2"))
    corners = _listed(elements).select("id", F.transform(F.slice("t", F.expr("4 + CAST(get(t, 2) AS INT)"), F.lit(3)), lambda c: c.cast("long")).alias("tags"))
    return {"vertices": vertices.select("id", "x"), "triangles": _by_tag(corners, vertices)}


def _by_tag(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """triangles(id, tags) with tags as vertex ids."""
    each = triangles.select("id", F.posexplode("tags").alias("at", "_tag")).join(vertices.select("_tag", F.col("id").alias("v")), "_tag")
    return each.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("v"))


def read_netgen(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """vertices(id, x) and triangles(id, v) of a Netgen volume file: its surface elements and points; vertices count from 1 there."""
    lines = _numbered(spark, path)
    name = lines.filter(F.col("line").isin("surfaceelements", "surfaceelementsgi", "surfaceelementsuv")).agg(F.min_by("line", "n")).first()[0] or "surfaceelements"
    rows = {}
    for section in (name, "points"):
        rest = _after(lines, section)
        n, first = (int(x) for x in rest.select("line", "n").orderBy("n").first())
        rows[section] = rest.filter(F.col("n").between(first + 1, first + n)).withColumn("id", (F.col("n") - first - 1).cast("long"))
    triangles = rows[name].select("id", F.transform(F.slice("t", 6, 3), lambda c: c.cast("long") - 1).alias("v"))
    return {"vertices": rows["points"].select("id", _real(1, 3).alias("x")), "triangles": triangles}


def read_unv(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """vertices(id, x) and triangles(id, v) of a universal file: data sets 2411 (two lines a node) and 2412 (an element's head of six numbers,
    a line of three for beams, and its corners). Elements other than those of three corners are left out."""
    lines = _numbered(spark, path)
    rows = _listed(_after(lines, "2411", "-1"))
    half = F.floor(F.col("id") / 2).cast("long").alias("id")
    number = F.transform("t", lambda c: F.regexp_replace(c, "[dD]", "e").try_cast("double"))  # exponents may be written with D
    vertices = rows.filter("id % 2 = 0").select(half, F.col("t")[0].cast("long").alias("_tag")).join(rows.filter("id % 2 = 1").select(half, number.alias("x")), "id")
    # A head is a line of six numbers with a line of as many corners as its last number says below it, or one line further for beams.
    cells = _after(lines, "2412", "-1")
    below = lambda k: cells.select((F.col("n") - k).alias("n"), F.col("t").alias("c"))
    heads = cells.filter((F.size("t") == 6) & (F.expr("get(t, 5)") == "3") & ~F.expr("get(t, 1)").isin("11", "21", "22", "23", "24"))
    corners = _listed(heads.select("n").join(below(1), "n").filter(F.size("c") == 3)).select("id", F.transform("c", lambda c: c.cast("long")).alias("tags"))
    return {"vertices": vertices.select("id", "x"), "triangles": _by_tag(corners, vertices)}


def with_edges(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(id, v) of triangles(id, v), and the triangles with e: edge k lies across from corner k. Edges are numbered by their corners."""
    each = triangles.select("id", "v", F.posexplode(F.expr("array(array(v[1], v[2]), array(v[2], v[0]), array(v[0], v[1]))")).alias("at", "p"))
    each = each.select("id", "v", "at", F.array_sort("p").alias("edge"))
    edges = renumbered(each.select("edge").distinct().select((F.col("edge")[0] * F.lit(1 << 31) + F.col("edge")[1]).alias("idx"), "edge")).select(F.col("idx").alias("e"), "edge")
    listed = each.join(edges, "edge").groupBy("id").agg(F.first("v").alias("v"), F.transform(F.sort_array(F.collect_list(F.struct("at", "e"))), lambda s: s["e"]).alias("e"))
    return edges.select(F.col("e").alias("id"), F.col("edge").alias("v")), listed


def _text(parts: list[tuple[DataFrame, list[str]]], header: list[str], path: str) -> None:
    """Sections of lines, each by id, as files whose names are in the text's order."""
    spark = parts[0][0].sparkSession
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(header)], "s int, id long, value string")
    for s, (df, columns) in enumerate(parts, 1):
        words = [F.array_join(F.transform(c, lambda v: v.cast("string")), " ") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in columns]
        lines = lines.unionByName(df.select(F.lit(s).alias("s"), "id", F.concat_ws(" ", *words).alias("value")))
    lines.repartitionByRange("s", "id").sortWithinPartitions("s", "id").select("value").write.mode("overwrite").text(path)


def write_surface(mesh: dict[str, DataFrame], path: str) -> None:
    counts = " ".join(str(mesh[k].count()) for k in ("vertices", "edges", "triangles"))
    _text([(mesh["vertices"], ["x"]), (mesh["edges"], ["v"]), (mesh["triangles"], ["v", "e"])], [counts], path)


def write_triangles(mesh: dict[str, DataFrame], path: str) -> None:
    counts = " ".join(str(mesh[k].count()) for k in ("vertices", "edges", "triangles"))
    _text([(mesh["vertices"], ["x", "boundary"]), (mesh["edges"], ["v", "boundary"]), (mesh["triangles"], ["e"])], ["# vertices, edges and triangles", counts], path)


def write_tetrahedra(mesh: dict[str, DataFrame], path: str) -> None:
    names = ["vertices", "edges", "faces", "tetrahedra"]
    columns = [["x", "boundary"], ["v", "boundary"], ["e", "boundary"], ["f"]]
    _text([(mesh[n], c) for n, c in zip(names, columns, strict=True)], ["# vertices, edges, faces and tetrahedra", " ".join(str(mesh[n].count()) for n in names)], path)


def read_ordered_text(spark: SparkSession, path: str, out: str) -> None:
    """The files of a folder that these writers made as one text file under `out`, in order. They are sorted by many tasks; the one that writes only passes lines on."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n"), "value")
    cut_lineage(lines.orderBy("f", "s", "n").select("value")).coalesce(1).write.mode("overwrite").text(out)


def write_clusters(nodes: DataFrame, path: str) -> None:
    """A cluster tree, one line a node: level, node, parent, size, leaf, box."""
    boxes = [c for c in nodes.columns if c.startswith(("min_", "max_"))]
    nodes.select("level", "node", "parent", "size", "leaf", *boxes).orderBy("level", "node").write.mode("overwrite").option("header", True).csv(path)


def read_clusters(spark: SparkSession, path: str, axes: list[str]) -> DataFrame:
    boxes = ", ".join(f"min_{a} double, max_{a} double" for a in axes)
    return spark.read.schema(f"level int, node long, parent long, size long, leaf boolean, {boxes}").option("header", True).option("enforceSchema", False).csv(path)


def printed(a: DataFrame, n_rows: int, n_cols: int, form: str = "%.3f") -> DataFrame:
    """(row, line): a small matrix of entries as text, zeros included; n_rows by n_cols is what is asked to be shown."""
    shown = a.filter((F.col("row") < n_rows) & (F.col("col") < n_cols)).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("m"))
    rows = a.sparkSession.range(n_rows).select(F.col("id").alias("row")).join(shown, "row", "left")
    cell = lambda c: F.format_string(form, F.coalesce(F.try_element_at("m", c), F.lit(0.0)))
    return rows.select("row", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_cols - 1).cast("long")), cell), " ").alias("line"))
