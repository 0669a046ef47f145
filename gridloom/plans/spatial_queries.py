"""Queries over the embeddings as points; coordinates are whole thousandths, so distances are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import spatial as sp
from ..session import table


def points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.round(e.cast("double") * 1000).cast("long").cast("double")).alias("x"), "label")


def low(s: SparkSession, d: str) -> DataFrame:
    """The first two coordinates."""
    return points(s, d).select("id", F.slice("x", 1, 2).alias("x"))


_Q = "(SELECT vec_id AS id, label, [CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT) FOR e IN embedding] AS x FROM embeddings)"
_D2 = "CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(a.x, b.x)]) AS DOUBLE)"
_KNN = f"(SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, nbr) - 1 AS INT) AS ord, nbr, d2 FROM (SELECT a.id, b.id AS nbr, {_D2} AS d2 FROM {_Q} a, {_Q} b))"
_LOW2 = "CAST((a.x[1] - b.x[1]) * (a.x[1] - b.x[1]) + (a.x[2] - b.x[2]) * (a.x[2] - b.x[2]) AS DOUBLE)"
_R2 = 1_600_000.0
_VALUE = "(SELECT id, CAST(label AS DOUBLE) AS v FROM " + _Q + ")"


def _values(s, d):
    return points(s, d).select(F.col("id").alias("idx"), F.col("label").cast("double").alias("v"))


QUERIES = {
    "knn_embeddings": (lambda s, d: sp.knn(points(s, d), points(s, d), 5), f"SELECT * FROM {_KNN} WHERE ord < 5"),
    "knn_search_among_label": (
        lambda s, d: sp.knn(points(s, d), points(s, d).filter("label = 0"), 3),
        f"SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, nbr) - 1 AS INT) AS ord, nbr, d2 FROM (SELECT a.id, b.id AS nbr, {_D2} AS d2 FROM {_Q} a, {_Q} b WHERE b.label = 0)) WHERE ord < 3",
    ),
    "knn_force_self": (
        lambda s, d: sp.force_self(sp.knn(points(s, d), points(s, d).filter("label = 0"), 3), 3),
        f"""WITH k AS (SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, nbr) - 1 AS INT) AS ord, nbr, d2 FROM (SELECT a.id, b.id AS nbr, {_D2} AS d2 FROM {_Q} a, {_Q} b WHERE b.label = 0)) WHERE ord < 3),
            o AS (SELECT id, nbr = id AS own FROM k WHERE ord = 0)
            SELECT k.id, CASE WHEN own THEN ord ELSE ord + 1 END AS ord, nbr, d2 FROM k JOIN o USING (id) WHERE own OR ord < 2
            UNION ALL SELECT id, 0, id, 0.0::DOUBLE FROM o WHERE NOT own""",
    ),
    "stencil_shrink": (lambda s, d: _shrunk(s, d), f"SELECT * FROM {_KNN} WHERE ord < 2"),
    "radius_join": (lambda s, d: sp.radius_join(points(s, d), points(s, d), _R2), f"SELECT * FROM (SELECT a.id, b.id AS nbr, {_D2} AS d2 FROM {_Q} a, {_Q} b) WHERE d2 < {_R2}"),
    "grid_radius_join": (
        lambda s, d: sp.grid_radius_join(low(s, d), low(s, d), 20.0, 2),
        f"SELECT * FROM (SELECT a.id, b.id AS nbr, {_LOW2} AS d2 FROM {_Q} a, {_Q} b) WHERE d2 < 400",
    ),
    "exists_in_sphere": (
        lambda s, d: sp.exists_in_sphere(points(s, d), points(s, d), _R2),
        f"SELECT a.id, coalesce(bool_or(a.id <> b.id AND {_D2} < {_R2}), false) AS found FROM {_Q} a, {_Q} b GROUP BY a.id",
    ),
    "separation_distance": (
        lambda s, d: sp.spacing(points(s, d)).select(*[F.round(c, 6).alias(c) for c in ("min_dist", "max_dist", "mean_dist")]),
        f"SELECT round(sqrt(min(m)), 6) AS min_dist, round(sqrt(max(m)), 6) AS max_dist, round(avg(sqrt(m)), 6) AS mean_dist FROM (SELECT a.id, min({_D2}) AS m FROM {_Q} a, {_Q} b WHERE a.id <> b.id GROUP BY a.id)",
    ),
    "shepard_interpolation": (
        lambda s, d: sp.shepard(sp.knn(points(s, d), points(s, d), 6).filter("nbr <> id"), _values(s, d)).select("id", F.round("v", 6).alias("v")),
        f"""WITH k AS (SELECT * FROM {_KNN} WHERE ord < 6 AND nbr <> id), n AS (SELECT k.*, v AS nv FROM k JOIN {_VALUE} x ON x.id = k.nbr)
            SELECT id, round(CASE WHEN min(d2) = 0 THEN arg_min(nv, d2 * 1e6 + nbr) ELSE sum(CASE WHEN d2 > 0 THEN nv / d2 END) / sum(CASE WHEN d2 > 0 THEN 1.0 / d2 END) END, 6) AS v FROM n GROUP BY id""",
    ),
    "symmetric_knn_graph": (
        lambda s, d: sp.symmetric_graph(sp.knn(points(s, d), points(s, d), 4)),
        f"SELECT src, dst, count(*) AS w FROM (SELECT id AS src, nbr AS dst FROM {_KNN} WHERE ord < 4 AND id <> nbr UNION ALL SELECT nbr, id FROM {_KNN} WHERE ord < 4 AND id <> nbr) GROUP BY src, dst",
    ),
    "bounding_boxes": (
        lambda s, d: cl.axis_boxes(points(s, d), "label"),
        f"SELECT label, CAST(i - 1 AS INT) AS axis, CAST(min(x[i]) AS DOUBLE) AS lo, CAST(max(x[i]) AS DOUBLE) AS hi FROM {_Q}, range(1, 65) r(i) GROUP BY label, i",
    ),
    "cluster_diam_dist": (
        lambda s, d: _diam_dist(s, d),
        f"""WITH b AS (SELECT label, i, min(x[i]) AS lo, max(x[i]) AS hi FROM {_Q}, range(1, 65) r(i) GROUP BY label, i)
            SELECT a.label AS r, c.label AS c, round(sqrt(sum((a.hi - a.lo) ** 2)), 6) AS diam, round(sqrt(sum(greatest(0, a.lo - c.hi, c.lo - a.hi) ** 2)), 6) AS dist,
                   CAST(max(a.hi - a.lo) AS DOUBLE) AS diam_max, CAST(max(greatest(0, a.lo - c.hi, c.lo - a.hi)) AS DOUBLE) AS dist_max
            FROM b a JOIN b c USING (i) GROUP BY a.label, c.label""",
    ),
    "poisson_disk_subset": (
        lambda s, d: sp.poisson_disk_subset(low(s, d), 900.0, 30.0).select("id"),
        f"""WITH RECURSIVE p AS (SELECT id, x[1] AS a, x[2] AS b, row_number() OVER (ORDER BY id) AS n FROM {_Q}),
            g(n, kept) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, a BIGINT, b BIGINT)[] UNION ALL
              SELECT p.n, CASE WHEN len([k FOR k IN kept IF (k.a - p.a) * (k.a - p.a) + (k.b - p.b) * (k.b - p.b) < 900]) = 0 THEN list_append(kept, struct_pack(id := p.id, a := p.a, b := p.b)) ELSE kept END FROM g JOIN p ON p.n = g.n + 1)
            SELECT unnest([k.id FOR k IN kept]) AS id FROM (SELECT kept FROM g ORDER BY n DESC LIMIT 1)""",
    ),
}


def _shrunk(s, d):
    from ..operators.ordered import shrink_stencil

    return shrink_stencil(sp.knn(points(s, d), points(s, d), 5), 2)


def _diam_dist(s, d):
    box = cl.axis_boxes(points(s, d), "label")
    a = box.select(F.col("label").alias("r"), "axis", "lo", "hi")
    c = box.select(F.col("label").alias("c"), "axis", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("hi2"), F.col("lo2") - F.col("hi"))
    return a.join(c, "axis").groupBy("r", "c").agg(
        F.round(F.sqrt(F.sum((F.col("hi") - F.col("lo")) ** 2)), 6).alias("diam"),
        F.round(F.sqrt(F.sum(gap**2)), 6).alias("dist"),
        F.max(F.col("hi") - F.col("lo")).alias("diam_max"),
        F.max(gap).alias("dist_max"),
    )
