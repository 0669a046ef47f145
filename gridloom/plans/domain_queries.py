"""Queries over node sets: parts as points of a plane, boxes and balls as shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import domains as dm
from ..operators import fronts as fr
from ..operators import graph as gr
from ..operators import pde
from ..operators import spatial as sp
from ..session import cut_lineage, table
from .graph_queries import _WITH, _sides, edges
from .part_nodes import GRID, TRIANGLES, mesh, nodes, side
from .spatial_queries import _Q, low, points


def _ball(c: str = "x"):
    return pde.in_ball(F.col(c), [0.5, 0.5], 0.4)


def _fine(s, d) -> float:
    """A power of two below the parts' spacing: sums of it are exact."""
    return 2.0 ** -((side(s, d) - 1).bit_length())


#: The step of _fine as `h`, and its number of steps to 1 as `n`.
_FINE = "(SELECT pow(2.0::DOUBLE, -k) AS h, CAST(pow(2, k) AS BIGINT) AS n FROM (SELECT min(k) AS k FROM range(31) r(k), (SELECT count(*) AS parts FROM part) WHERE pow(2, k) > floor(sqrt(parts)) - 1))"


def _fill(s, d):
    return dm.grid_fill(s, _ball(), [0.0, 0.0], [1.0, 1.0], _fine(s, d)).select("id")


def _boxes(s, d):
    """The parts' nodes, and the same moved by half a side."""
    # By the size of their file the planner would broadcast all nodes.
    a = cut_lineage(nodes(s, d).select("id", "x"), sized=False)
    return a, a.select((F.col("id") + 1_000_000_000).alias("id"), F.transform("x", lambda v: v + 0.5).alias("x"))


_G = f"(SELECT idx AS id, m, x, y FROM {GRID})"
_H = f"(SELECT idx + 1000000000 AS id, m, x + 0.5 AS x, y + 0.5 AS y FROM {GRID})"
_NEAR = "EXISTS (SELECT 1 FROM {o} o WHERE (p.x - o.x) ** 2 + (p.y - o.y) ** 2 < 0.75 / ((p.m - 1) * (p.m - 1)))"


def _union(s, d):
    a, b = _boxes(s, d)
    return dm.union(a, b, pde.in_box(F.col("x"), [0.0, 0.0], [1.0, 1.0]), 1 / (side(s, d) - 1), 2).select("id")


def _difference(s, d):
    a, b = _boxes(s, d)
    return dm.difference(a, b, pde.in_box(F.col("x"), [0.5, 0.5], [1.5, 1.5]), 1 / (side(s, d) - 1), 2).select("id")


def _dissected(s, d):
    p = low(s, d).select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    e = sp.symmetric_graph(sp.knn(low(s, d), low(s, d), 6))
    return dm.nested_dissection(p, e, ["a", "b"], 3, 20).select("id", "node", "separator")


def _cover_is_valid(s, d):
    """Edges between the sides that the least separator misses: none."""
    e = edges(s, d)
    sep = dm.minimum_separator(e, _sides(s, d))
    cut = e.join(_sides(s, d).select(F.col("id").alias("src"), F.col("side").alias("a")), "src").join(_sides(s, d).select(F.col("id").alias("dst"), F.col("side").alias("b")), "dst").filter("a <> b")
    missed = cut.join(sep.select(F.col("id").alias("src")), "src", "left_anti").join(sep.select(F.col("id").alias("dst")), "dst", "left_anti")
    return missed.agg(F.count(F.lit(1)).alias("missed"))


def _restricted(s, d):
    nodes = low(s, d).withColumn("type", F.when(F.col("x")[0] > 150, -1).otherwise(1))
    p = cl.bisect(low(s, d).select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), ["a", "b"], 30, 3)
    return dm.restricted_support(nodes, 4, p.select("id", "node", F.lit(False).alias("separator")))


def _front_fill(s, d):
    """The square filled from the parts on its faces: whether each part has a node within 1.3 spacings, and whether any such node has another one too near."""
    m = side(s, d)
    spacing = lambda x: (4 + 2 * x[0]) / m
    given = cut_lineage(nodes(s, d), sized=False)
    inside = lambda x: (x[0] >= 0) & (x[0] <= 1) & (x[1] >= 0) & (x[1] <= 1)
    filled = fr.fill(given.filter("type < 0").select("id", "x"), spacing, inside, 2)
    sized = lambda n, share: n.select("id", "x", (spacing(F.col("x")) * share).alias("reach"))
    crowded = fr.within_reach(sized(filled.filter("generation > 0"), 0.7), filled, 2).filter(F.col("nbr") != F.col("id")).select(F.col("id").alias("nbr"), F.lit(True).alias("crowded")).distinct()
    near = fr.within_reach(sized(given, 1.3), filled, 2).join(crowded, "nbr", "left").groupBy("id").agg(F.coalesce(F.max("crowded"), F.lit(False)).alias("crowded"))
    return given.select("id").join(near, "id", "left").select("id", F.col("crowded").isNotNull().alias("covered"), F.coalesce("crowded", F.lit(False)).alias("crowded"))


def _cut_levels() -> str:
    """Three bisections of p(id, a, b) with leaves of up to 30."""
    out = "n0 AS (SELECT id, a, b, CAST(1 AS BIGINT) AS node FROM p)"
    for i in range(3):
        out += f""", c{i} AS (SELECT node, count(*) AS n, max(a) - min(a) AS ea, max(b) - min(b) AS eb, (max(a) + min(a)) * 0.5 AS ma, (max(b) + min(b)) * 0.5 AS mb FROM n{i} WHERE node >= {1 << i} GROUP BY node),
        n{i + 1} AS (SELECT id, a, b, CASE WHEN c.node IS NULL OR n <= 30 OR greatest(ea, eb) <= 0 THEN v.node
            ELSE 2 * v.node + CASE WHEN ea >= eb THEN (a >= ma)::INT ELSE (b >= mb)::INT END END AS node FROM n{i} v LEFT JOIN c{i} c USING (node))"""
    return out


QUERIES = {
    "front_fill": (_front_fill, f"SELECT idx AS id, true AS covered, false AS crowded FROM {GRID}"),
    "grid_fill": (_fill, f"SELECT i * (n + 1) + j AS id FROM {_FINE}, range((SELECT n + 1 FROM {_FINE})) a(i), range((SELECT n + 1 FROM {_FINE})) b(j) WHERE (i * h - 0.5) ** 2 + (j * h - 0.5) ** 2 < 0.4 * 0.4"),
    "domain_union": (_union, f"SELECT id FROM {_G} UNION ALL SELECT id FROM {_H} p WHERE NOT (x > 0 AND x < 1 AND y > 0 AND y < 1) AND NOT {_NEAR.format(o=_G)}"),
    "domain_difference": (_difference, f"SELECT id FROM {_G} p WHERE NOT (x > 0.5 AND x < 1.5 AND y > 0.5 AND y < 1.5) AND NOT {_NEAR.format(o=_H)}"),
    "balanced_support": (
        lambda s, d: dm.balanced_support(low(s, d), 5, 12),
        f"""WITH p AS (SELECT id, x[1] AS a, x[2] AS b FROM {_Q}),
            k AS (SELECT * FROM (SELECT p.id, CAST(row_number() OVER (PARTITION BY p.id ORDER BY (p.a - q.a) ** 2 + (p.b - q.b) ** 2, q.id) - 1 AS INT) AS ord, q.id AS nbr,
                  CAST((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) AS DOUBLE) AS d2, CASE WHEN p.id <> q.id THEN 2 * (q.a >= p.a)::INT + (q.b >= p.b)::INT END AS o FROM p, p q) WHERE ord < 12),
            f AS (SELECT id, count(*) AS n, max(first_at) AS last_at FROM (SELECT id, o, min(ord) AS first_at FROM k WHERE o IS NOT NULL GROUP BY id, o) GROUP BY id)
            SELECT id, ord, nbr, d2 FROM k JOIN f USING (id) WHERE ord < CASE WHEN n = 4 THEN greatest(last_at + 1, 5) ELSE 12 END""",
    ),
    "restricted_support": (
        _restricted,
        f"""WITH p AS (SELECT id, x[1] AS a, x[2] AS b FROM {_Q}), {_cut_levels()},
            m AS (SELECT n3.id, n3.node, p.a, p.b, p.a > 150 AS edge FROM n3 JOIN p USING (id)),
            k AS (SELECT q.id, o.id AS nbr, CAST((q.a - o.a) ** 2 + (q.b - o.b) ** 2 AS DOUBLE) AS d2 FROM m q, m o WHERE NOT q.edge AND (o.edge OR o.node = q.node))
            SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, nbr) - 1 AS INT) AS ord, nbr, d2 FROM k) WHERE ord < 4""",
    ),
    "nested_dissection": (_dissected, None),
    "minimum_separator": (_cover_is_valid, "SELECT CAST(0 AS BIGINT) AS missed"),
    "minimum_separator_vertices": (lambda s, d: dm.minimum_separator(edges(s, d), _sides(s, d)), None),
    "partition_of_unity": (
        lambda s, d: _unity(s, d),
        f"""WITH p AS (SELECT id, label, x[1] AS a, x[2] AS b FROM {_Q}),
            k AS (SELECT * FROM (SELECT p.id, q.id AS nbr, (p.a - q.a) ** 2 + (p.b - q.b) ** 2 AS d2, row_number() OVER (PARTITION BY p.id ORDER BY (p.a - q.a) ** 2 + (p.b - q.b) ** 2, q.id) AS n FROM p, p q) WHERE n <= 5),
            r AS (SELECT id AS nbr, max(d2) AS reach FROM k GROUP BY id)
            SELECT q.id, round(sum((1 - sqrt(d2 / (1.21 * reach))) * p.label) / sum(1 - sqrt(d2 / (1.21 * reach))), 6) AS v
            FROM (SELECT q.id, r.nbr, (p.a - q.a) ** 2 + (p.b - q.b) ** 2 AS d2, reach FROM p q, p JOIN r ON r.nbr = p.id) q JOIN p ON p.id = q.nbr WHERE d2 < 1.21 * reach GROUP BY q.id""",
    ),
    "ghost_nodes": (
        lambda s, d: pde.ghost_nodes(nodes(s, d), 1 / (side(s, d) - 1), 1_000_000_000).select("id", F.round(F.col("x")[0], 9).alias("x"), F.round(F.col("x")[1], 9).alias("y")),
        f"""SELECT idx + 1000000000 AS id, round(x + CASE type WHEN -1 THEN -1.0 WHEN -2 THEN 1.0 ELSE 0.0 END::DOUBLE / (m - 1), 9) AS x, round(y + CASE type WHEN -3 THEN -1.0 WHEN -4 THEN 1.0 ELSE 0.0 END::DOUBLE / (m - 1), 9) AS y FROM {GRID} WHERE type < 0""",
    ),
    "mesh_edges": (
        lambda s, d: pde.mesh_edges(mesh(s, d)[1]),
        f"SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS n FROM (SELECT a AS p, b AS q FROM {TRIANGLES} UNION ALL SELECT b, c FROM {TRIANGLES} UNION ALL SELECT c, a FROM {TRIANGLES}) GROUP BY 1, 2",
    ),
    "lcg_vector": (
        lambda s, d: dm.lcg_vector(s, table(s, d, "part").count(), 1).select("idx", F.round("v", 12).alias("v")),
        "WITH RECURSIVE r AS (SELECT 0::BIGINT AS idx, 16807::BIGINT AS x UNION ALL SELECT idx + 1, x * 16807 % 2147483647 FROM r WHERE idx < (SELECT count(*) - 1 FROM part)) SELECT idx, round(x / 2147483647.0::DOUBLE - 0.5, 12) AS v FROM r",
    ),
}


def _unity(s, d):
    p = low(s, d)
    support = sp.knn(p, p, 5)
    reach = support.groupBy(F.col("id").alias("nbr")).agg(F.max("d2").alias("reach2"))
    most = reach.agg(F.max("reach2")).first()[0] * 1.21
    near = sp.radius_join(p, p, most * 1.0001).join(reach, "nbr")
    value = points(s, d).select(F.col("id").alias("nbr"), F.col("label").cast("double").alias("approx"))
    return sp.partition_of_unity(near, near.select("id", "nbr").join(value, "nbr"), 1.1).select("id", F.round("v", 6).alias("v"))
