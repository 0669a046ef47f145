"""Queries over the graph of users: an edge for each two users with events of one type in a row within an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..session import table


def edges(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    w = W.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    pairs = e.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).filter("dst IS NOT NULL AND src <> dst")
    return gr.symmetric(pairs.groupBy("src", "dst").agg((F.lit(1) + (F.min("src") * 7 + F.min("dst") * 3) % 5).cast("double").alias("w")))


_E = """(SELECT src, dst, min(w) AS w FROM (
  SELECT src, dst, CAST(1 + (src * 7 + dst * 3) % 5 AS DOUBLE) AS w FROM p UNION ALL SELECT dst, src, CAST(1 + (src * 7 + dst * 3) % 5 AS DOUBLE) FROM p) GROUP BY src, dst)"""
_WITH = f"""p AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst),
e AS {_E}, v AS (SELECT DISTINCT src AS id FROM e), s0 AS (SELECT min(id) AS id FROM v)"""


def _relaxed(rounds: int) -> str:
    out = "d0 AS (SELECT id, 0.0::DOUBLE AS dist FROM s0)"
    for i in range(1, rounds + 1):
        out += f", d{i} AS (SELECT id, min(dist) AS dist FROM (SELECT * FROM d{i - 1} UNION ALL SELECT e.dst, d.dist + e.w FROM e JOIN d{i - 1} d ON e.src = d.id) GROUP BY id)"
    return out


#: What passes between two of the n nearest is among them too, so n - 1 rounds that keep n vertices a source are exact.
_STENCIL = 6


def _stencils() -> str:
    out = "n0 AS (SELECT id AS source, id, 0.0::DOUBLE AS dist FROM v)"
    for i in range(1, _STENCIL):
        out += f""", n{i} AS MATERIALIZED (SELECT source, id, min(dist) AS dist FROM (SELECT * FROM n{i - 1} UNION ALL SELECT n.source, e.dst, n.dist + e.w FROM n{i - 1} n JOIN e ON e.src = n.id)
          GROUP BY source, id QUALIFY row_number() OVER (PARTITION BY source ORDER BY min(dist), id) <= {_STENCIL})"""
    return f"{out} SELECT source, id, dist, CAST(row_number() OVER (PARTITION BY source ORDER BY dist, id) - 1 AS INT) AS rank FROM n{_STENCIL - 1}"


def _vertices(s, d):
    return edges(s, d).select(F.col("src").alias("id")).distinct()


def _start(s, d):
    return _vertices(s, d).agg(F.min("id").alias("id"))


def _sides(s, d):
    return _vertices(s, d).select("id", F.when(F.col("id") % 5 < 2, 0).otherwise(1).alias("side"))


QUERIES = {
    "user_graph": (lambda s, d: edges(s, d), f"WITH {_WITH} SELECT src, dst, w FROM e"),
    "bfs_levels": (
        lambda s, d: gr.bfs_levels(edges(s, d), _start(s, d)),
        f"WITH RECURSIVE {_WITH}, r AS (SELECT id, 0 AS level FROM s0 UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id WHERE r.level < 12) SELECT id, min(level) AS level FROM r GROUP BY id",
    ),
    "connected_components": (
        lambda s, d: gr.components(edges(s, d)),
        f"WITH RECURSIVE {_WITH}, r AS (SELECT src AS id, src AS reach FROM e UNION SELECT r.id, e.dst FROM r JOIN e ON e.src = r.reach) SELECT id, min(reach) AS component FROM r GROUP BY id",
    ),
    "simple_separator": (
        lambda s, d: gr.simple_separator(edges(s, d), _sides(s, d)),
        f"""WITH {_WITH}, t AS (SELECT id, CASE WHEN id % 5 < 2 THEN 0 ELSE 1 END AS side FROM v),
            n AS (SELECT count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM t)
            SELECT DISTINCT a.id FROM t a JOIN e ON e.src = a.id JOIN t b ON b.id = e.dst, n WHERE a.side <> b.side AND a.side = CASE WHEN n0 < n1 THEN 1 ELSE 0 END""",
    ),
    "graph_connected": (
        lambda s, d: gr.is_connected(edges(s, d), _vertices(s, d)),
        f"WITH RECURSIVE {_WITH}, r AS (SELECT id FROM s0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT count(*) = 0 AS connected FROM v WHERE id NOT IN (SELECT id FROM r)",
    ),
    "dijkstra": (lambda s, d: gr.shortest_paths(edges(s, d), _start(s, d)), f"WITH {_WITH}, {_relaxed(14)} SELECT id, dist FROM d14"),
    "dijkstra_n_nearest": (
        lambda s, d: gr.n_nearest(edges(s, d), _start(s, d).first()["id"], 10),
        f"WITH {_WITH}, {_relaxed(14)} SELECT id, dist FROM d14 ORDER BY dist, id LIMIT 10",
    ),
    "graph_stencils": (lambda s, d: gr.nearest_by_path(edges(s, d), _vertices(s, d), _STENCIL), f"WITH {_WITH}, {_stencils()}"),
    "induced_subgraph": (
        lambda s, d: gr.induced(edges(s, d), _sides(s, d).filter("side = 1")).select("src", "dst", "w"),
        f"WITH {_WITH} SELECT src, dst, w FROM e WHERE src % 5 >= 2 AND dst % 5 >= 2",
    ),
    "pressure_partition_majority": (
        lambda s, d: gr.majority_side(edges(s, d).select(F.col("src").alias("id"), F.col("dst").alias("nbr")), _sides(s, d)),
        f"""WITH {_WITH}, c AS (SELECT src AS id, count(*) FILTER (dst % 5 < 2) AS n0, count(*) FILTER (NOT dst % 5 < 2) AS n1 FROM e GROUP BY src)
            SELECT id, CAST(CASE WHEN n0 > n1 THEN 0 WHEN n0 < n1 THEN 1 ELSE id % 2 END AS INT) AS side FROM c""",
    ),
    "stencil_update": (
        lambda s, d: gr.stencil_update(edges(s, d).select(F.col("src").alias("id"), F.col("dst").alias("nbr")), _vertices(s, d), _sides(s, d).filter("side = 1")),
        f"WITH {_WITH} SELECT DISTINCT src AS id FROM e WHERE dst % 5 < 2",
    ),
    "two_front_partition": (lambda s, d: gr.two_front_partition(edges(s, d), _vertices(s, d)), None),
}

# The names these two had beside queries of some weights only; they take all edges under both.
QUERIES |= {f"{name}_all_edges": QUERIES[name] for name in ("connected_components", "simple_separator")}
