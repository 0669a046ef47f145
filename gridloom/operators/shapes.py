"""Surfaces as nodes: lines, circles, spheres, triangles and meshes, their normals, fills by density, and node types.

Nodes are (id, x, type, normal): type 1 inside, negative on a boundary. What a surface
element's nodes are depends on the element alone, so a mesh is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def line(spark: SparkSession, p: list[float], q: list[float], h: float, first_id: int = 0, kind: int = -1) -> DataFrame:
    """Nodes from p to q, both included, evenly spaced by at most h; in the plane with the normal to the right of the way."""
    length = sum((b - a) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5
    n = max(1, ceil(length / h - 1e-9))
    at = F.array(*[F.lit(float(a)) + F.lit(float(b - a)) * F.col("id") / n for a, b in zip(p, q, strict=True)])
    normal = F.array(F.lit((q[1] - p[1]) / length), F.lit((p[0] - q[0]) / length)) if len(p) == 2 else F.lit(None).cast("array<double>")
    return spark.range(n + 1).select((F.col("id") + first_id).alias("id"), at.alias("x"), F.lit(kind).alias("type"), normal.alias("normal"))


def line_by_density(p: list[float], q: list[float], spacing: Callable[[list[float]], float]) -> list[list[float]]:
    """Points from p to q, each `spacing` of the last one beyond it; stretched so that q is the last. A line is short, so it is made on the driver."""
    length = sum((b - a) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5
    point = lambda s: [a + (b - a) * s / length for a, b in zip(p, q, strict=True)]
    at = [0.0]
    while at[-1] < length:
        step = spacing(point(at[-1]))
        if step <= 0:
            raise ValueError("a spacing must be positive")
        at.append(at[-1] + step)
    stretch = length / at[-1] if at[-1] - length < length - at[-2] or len(at) == 2 else length / at[-2]
    kept = [s * stretch for s in at if s * stretch <= length * (1 + 1e-12)]
    return [point(min(s, length)) for s in kept]


def circle(spark: SparkSession, centre: list[float], radius: float, h: float, first_id: int = 0, kind: int = -1) -> DataFrame:
    """Evenly spaced nodes of a circle with outward normals."""
    n = max(3, ceil(2 * pi * radius / h - 1e-9))
    angle = F.col("id") * F.lit(2 * pi / n)
    out = F.array(F.cos(angle), F.sin(angle))
    return spark.range(n).select((F.col("id") + first_id).alias("id"), F.array(*[F.lit(float(c)) + radius * out[d] for d, c in enumerate(centre)]).alias("x"), F.lit(kind).alias("type"), out.alias("normal"))


def sphere(spark: SparkSession, centre: list[float], radius: float, h: float, first_id: int = 0, kind: int = -1) -> DataFrame:
    """Nodes of a sphere by rings of latitude, each ring evenly spaced by about h, with outward normals."""
    rings = max(2, ceil(pi * radius / h - 1e-9))
    polar = F.col("id") * F.lit(pi / rings)
    size = F.greatest(F.lit(1), F.ceil(2 * pi * radius * F.sin(polar) / h - 1e-9)).cast("int")
    each = spark.range(rings + 1).select("id", polar.alias("polar"), size.alias("n")).select("id", "polar", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    turn = F.col("k") * F.lit(2 * pi) / F.col("n")
    out = F.array(F.sin("polar") * F.cos(turn), F.sin("polar") * F.sin(turn), F.cos("polar"))
    stride = ceil(2 * pi * radius / h) + 2
    return each.select((F.col("id") * stride + F.col("k") + first_id).alias("id"), F.array(*[F.lit(float(c)) + radius * out[d] for d, c in enumerate(centre)]).alias("x"), F.lit(kind).alias("type"), out.alias("normal"))


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces(id, v) of triangles with their corners a, b, c; vertices(id, x)."""
    out = faces
    for k, name in enumerate("abc"):
        out = out.withColumn("_v", F.col("v")[k]).join(vertices.select(F.col("id").alias("_v"), F.col("x").alias(name)), "_v").drop("_v")
    return out


def _minus(a: str, b: str) -> list[Column]:
    return [F.col(a)[d] - F.col(b)[d] for d in range(3)]


def face_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, normal, area) of triangles, by the right-hand rule; the normal of an empty triangle is null."""
    u, v = _minus("b", "a"), _minus("c", "a")
    n = [u[(d + 1) % 3] * v[(d + 2) % 3] - u[(d + 2) % 3] * v[(d + 1) % 3] for d in range(3)]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return corners(faces, vertices).select("id", F.when(size > 0, F.array(*[x / size for x in n])).alias("normal"), (size / 2).alias("area"))


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, normal) of vertices: the mean of their triangles' normals by area."""
    weighted = faces.join(face_normals(faces, vertices).filter("area > 0"), "id").select(F.explode("v").alias("id"), *[(F.col("normal")[d] * F.col("area")).alias(f"n{d}") for d in range(3)])
    total = weighted.groupBy("id").agg(*[F.sum(f"n{d}").alias(f"n{d}") for d in range(3)])
    size = F.sqrt(F.col("n0") ** 2 + F.col("n1") ** 2 + F.col("n2") ** 2)
    return total.select("id", F.when(size > 0, F.array(*[F.col(f"n{d}") / size for d in range(3)])).alias("normal"))


def curve_normal(tangent: Column) -> Column:
    """The unit normal to the right of a plane curve's tangent."""
    size = F.sqrt(tangent[0] * tangent[0] + tangent[1] * tangent[1])
    return F.array(tangent[1] / size, -tangent[0] / size)


def mesh_nodes(faces: DataFrame, vertices: DataFrame, h: float, kind: int = -1) -> DataFrame:
    """(face, i, j, x, type, normal): the inner points of each triangle's grid of lines at most h apart.

    With n lines a side they are the points (i, j), i + j < n, of barycentric coordinates with i, j > 0, so
    no two triangles make the same node; vertices and edges are nodes of their own (`mesh_edge_nodes`).
    """
    u, v, w = _minus("b", "a"), _minus("c", "a"), _minus("c", "b")
    longest = F.sqrt(F.greatest(*[x[0] * x[0] + x[1] * x[1] + x[2] * x[2] for x in (u, v, w)]))
    placed = corners(faces, vertices).join(face_normals(faces, vertices), "id").withColumn("n", F.greatest(F.lit(1), F.ceil(longest / h - 1e-9)).cast("int"))
    inner = placed.filter("n > 2").select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 2)).alias("i")).select("*", F.explode(F.expr("sequence(1, n - 1 - i)")).alias("j"))
    x = F.array(*[F.col("a")[d] + u[d] * F.col("i") / F.col("n") + v[d] * F.col("j") / F.col("n") for d in range(3)])
    return inner.select(F.col("id").alias("face"), "i", "j", x.alias("x"), F.lit(kind).alias("type"), "normal")


def mesh_edge_nodes(faces: DataFrame, vertices: DataFrame, h: float, kind: int = -1) -> DataFrame:
    """(a, b, i, x, type): the inner points of each edge once, at most h apart."""
    edges = faces.select(F.explode(F.expr("array(array(v[0], v[1]), array(v[1], v[2]), array(v[2], v[0]))")).alias("e")).select(F.array_min("e").alias("a"), F.array_max("e").alias("b")).distinct()
    ends = edges.join(vertices.select(F.col("id").alias("a"), F.col("x").alias("p")), "a").join(vertices.select(F.col("id").alias("b"), F.col("x").alias("q")), "b")
    d = _minus("q", "p")
    sized = ends.withColumn("n", F.greatest(F.lit(1), F.ceil(F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2) / h - 1e-9)).cast("int")).filter("n > 1")
    inner = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("i"))
    return inner.select("a", "b", "i", F.array(*[F.col("p")[k] + d[k] * F.col("i") / F.col("n") for k in range(3)]).alias("x"), F.lit(kind).alias("type"))


def in_polyhedron(points: DataFrame, faces: DataFrame, vertices: DataFrame, cell: float) -> DataFrame:
    """(id): points inside a closed mesh of triangles: their rays along the first axis cross it an odd number of times.

    Triangles are dealt to the cells of their shadow, so a point only meets triangles of its own cell. Points
    on the surface or level with a vertex or an edge may fall on either side; shift them a little.
    """
    low = lambda d: F.floor(F.least(*[F.col(k)[d] for k in "abc"]) / cell).cast("long")
    high = lambda d: F.floor(F.greatest(*[F.col(k)[d] for k in "abc"]) / cell).cast("long")
    dealt = corners(faces, vertices).select("a", "b", "c", F.explode(F.sequence(low(1), high(1))).alias("cy"), low(2).alias("_l"), high(2).alias("_h"))
    dealt = dealt.select("a", "b", "c", "cy", F.explode(F.sequence("_l", "_h")).alias("cz"))
    own = points.select("id", "x", F.floor(F.col("x")[1] / cell).cast("long").alias("cy"), F.floor(F.col("x")[2] / cell).cast("long").alias("cz"))
    met = own.join(dealt, ["cy", "cz"])
    side = lambda p, q: (F.col(q)[1] - F.col(p)[1]) * (F.col("x")[2] - F.col(p)[2]) - (F.col(q)[2] - F.col(p)[2]) * (F.col("x")[1] - F.col(p)[1])
    s = [side("a", "b"), side("b", "c"), side("c", "a")]
    within = ((s[0] > 0) & (s[1] > 0) & (s[2] > 0)) | ((s[0] < 0) & (s[1] < 0) & (s[2] < 0))
    # Barycentric weights of the shadow place the crossing.
    total = s[0] + s[1] + s[2]
    crossing = (s[1] * F.col("a")[0] + s[2] * F.col("b")[0] + s[0] * F.col("c")[0]) / total
    hits = met.filter(within).filter(crossing > F.col("x")[0]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("n") % 2 == 1).select("id")


def density_fill(spark: SparkSession, inside: Column, lo: list[float], hi: list[float], spacing: Column, least: float, levels: int = 8) -> DataFrame:
    """(id, x): grid nodes whose spacing follows `spacing`, a Column of x: the grid of step least * 2^k serves where the spacing is in [step, 2 step).

    Grids nest, so each node is one of the finest grid, with its id.
    """
    from .ranges import grid

    counts = [int((b - a) / least + 1e-9) + 1 for a, b in zip(lo, hi, strict=True)]
    top = [a + least * (n - 1) for a, n in zip(lo, counts, strict=True)]
    nodes = grid(spark, lo, top, counts).filter(inside).withColumn("_s", spacing)
    level = F.least(F.lit(levels), F.greatest(F.lit(0), F.floor(F.log2(F.col("_s") / least) + 1e-9))).cast("int")
    step = F.pow(F.lit(2), level).cast("long")
    on_grid = F.lit(True)
    stride = 1
    for n in reversed(counts):  # the last index is the fastest
        on_grid = on_grid & (F.floor(F.col("id") / stride) % n % step == 0)
        stride *= n
    return nodes.filter(on_grid).select("id", "x")


def to_boundary(nodes: DataFrame, which: Column, kind: int, normal: Column) -> DataFrame:
    """Nodes with those that `which` holds for turned into boundary nodes."""
    return nodes.withColumn("normal", F.when(which, normal).otherwise(F.col("normal"))).withColumn("type", F.when(which, F.lit(kind)).otherwise(F.col("type")))


def to_interior(nodes: DataFrame, which: Column, kind: int = 1) -> DataFrame:
    return nodes.withColumn("normal", F.when(~which, F.col("normal"))).withColumn("type", F.when(which, F.lit(kind)).otherwise(F.col("type")))


def plugged(nodes: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fills, supports and relaxations of the user's own, one after the other."""
    for step in steps:
        nodes = nodes.transform(step)
    return nodes
