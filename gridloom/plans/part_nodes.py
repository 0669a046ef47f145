"""Parts as scattered nodes of the unit square, for the queries over fields and domains: what they cost grows with the table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Parts as nodes of the unit square: the first m^2 keys on a lattice, inner ones moved by size and by the price's
#: fraction, at most a tenth of a step; the others in the middles of its first cells. Faces have the types -1 to -4.
GRID = """(WITH m AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS m FROM part),
  k AS (SELECT p_partkey AS idx, m, p_partkey // m AS i, p_partkey % m AS j, p_partkey >= m * m AS extra, p_partkey - m * m AS e, 0.004::DOUBLE * (p_size - 25) AS dx, 0.2::DOUBLE * (p_retailprice - floor(p_retailprice) - 0.5) AS dy FROM part, m),
  t AS (SELECT *, CASE WHEN extra THEN 1 WHEN i = 0 THEN -1 WHEN i = m - 1 THEN -2 WHEN j = 0 THEN -3 WHEN j = m - 1 THEN -4 ELSE 1 END::INT AS type FROM k)
  SELECT idx, m, type, CASE WHEN extra THEN e // (m - 1) + 0.5 WHEN type < 0 THEN i ELSE i + dx END::DOUBLE / (m - 1) AS x, CASE WHEN extra THEN e % (m - 1) + 0.5 WHEN type < 0 THEN j ELSE j + dy END::DOUBLE / (m - 1) AS y FROM t)"""
EDGE = "type < 0"


def side(s: SparkSession, d: str) -> int:
    return math.isqrt(table(s, d, "part").count())


def nodes(s: SparkSession, d: str) -> DataFrame:
    """nodes(id, x, type, normal) of the parts, as GRID has them."""
    m = side(s, d)
    k = F.col("p_partkey")
    i, j, extra, e = F.floor(k / m), k % m, k >= m * m, k - m * m
    dx, dy = F.lit(0.004) * (F.col("p_size") - 25), F.lit(0.2) * (F.col("p_retailprice") - F.floor("p_retailprice") - 0.5)
    kind = F.when(extra, 1).when(i == 0, -1).when(i == m - 1, -2).when(j == 0, -3).when(j == m - 1, -4).otherwise(1)
    typed = table(s, d, "part").select(k.alias("id"), kind.alias("type"), i.alias("i"), j.alias("j"), extra.alias("extra"), e.alias("e"), dx.alias("dx"), dy.alias("dy"))
    place = lambda lattice, cell, moved: F.when(F.col("extra"), cell + 0.5).when(F.col("type") < 0, F.col(lattice)).otherwise(F.col(lattice) + F.col(moved)).cast("double") / (m - 1)
    x = F.array(place("i", F.floor(F.col("e") / (m - 1)), "dx"), place("j", F.col("e") % (m - 1), "dy"))
    normal = F.when(F.col("type") == -1, F.array(F.lit(-1.0), F.lit(0.0))).when(F.col("type") == -2, F.array(F.lit(1.0), F.lit(0.0))).when(F.col("type") == -3, F.array(F.lit(0.0), F.lit(-1.0))).when(F.col("type") == -4, F.array(F.lit(0.0), F.lit(1.0)))
    return typed.select("id", x.alias("x"), "type", normal.alias("normal"))


#: Two triangles of each cell of the lattice of the first m^2 parts.
TRIANGLES = f"""(WITH g AS (SELECT idx, m FROM {GRID} WHERE idx < m * m AND idx // m < m - 1 AND idx % m < m - 1)
  SELECT 2 * idx AS id, idx AS a, idx + m AS b, idx + m + 1 AS c FROM g UNION ALL SELECT 2 * idx + 1, idx, idx + m + 1, idx + 1 FROM g)"""


def mesh(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """vertices(id, x) and triangles(id, v), as TRIANGLES has them."""
    m = side(s, d)
    vertices = nodes(s, d).filter(F.col("id") < m * m).select("id", "x")
    k = F.col("id")
    cells = vertices.filter((F.floor(k / m) < m - 1) & (k % m < m - 1))
    both = cells.select(F.explode(F.array(F.struct((2 * k).alias("id"), F.array(k, k + m, k + m + 1).alias("v")), F.struct((2 * k + 1).alias("id"), F.array(k, k + m + 1, k + 1).alias("v")))).alias("t"))
    return vertices, both.select("t.id", "t.v")
