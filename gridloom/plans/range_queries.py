"""Queries over index sets and positional lists of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges as rg
from ..session import table


def _sizes(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("long").alias("v"))


def _count(s, d, name: str) -> int:
    return table(s, d, name).count()


_P = "(SELECT p_partkey AS idx, CAST(p_size AS BIGINT) AS v FROM part)"

QUERIES = {
    "range_seq": (lambda s, d: rg.seq(s, 3, _count(s, d, "part"), 4), "SELECT i AS idx FROM range(3, (SELECT count(*) FROM part), 4) t(i)"),
    "linspace": (lambda s, d: rg.linspace(s, 0.0, 4.0, _count(s, d, "part")), "SELECT p_partkey AS idx, p_partkey * (4.0::DOUBLE / ((SELECT count(*) FROM part) - 1)) AS v FROM part"),
    "linspace_grid": (
        lambda s, d: rg.grid(s, [0.0, 1.0], [1.0, 3.0], [_count(s, d, "nation"), _count(s, d, "supplier")]).select("id", F.col("x")[0].alias("x"), F.col("x")[1].alias("y")),
        "WITH c AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM supplier) AS m) SELECT n_nationkey * m + s_suppkey AS id, n_nationkey * (1.0::DOUBLE / (n - 1)) AS x, 1 + s_suppkey * (2.0::DOUBLE / (m - 1)) AS y FROM nation, supplier, c",
    ),
    "filter_indices": (lambda s, d: rg.filter_indexes(_sizes(s, d), F.col("v") > 25), f"SELECT idx FROM {_P} WHERE v > 25"),
    "element_map": (lambda s, d: _sizes(s, d).select("idx", (F.col("v") * F.col("v") + 1).alias("v")), f"SELECT idx, v * v + 1 AS v FROM {_P}"),
    "gather": (
        lambda s, d: rg.gather(_sizes(s, d), table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_partkey").alias("idx"))).select("ord", "idx", "v"),
        f"SELECT l_orderkey * 10 + l_linenumber AS ord, idx, v FROM lineitem JOIN {_P} p ON p.idx = l_partkey",
    ),
    "scatter": (
        lambda s, d: rg.scatter(_sizes(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("idx"), (-F.col("s_suppkey")).alias("v"))),
        f"SELECT idx, coalesce(-s_suppkey, v) AS v FROM {_P} LEFT JOIN supplier ON s_suppkey = idx",
    ),
    "remove_indices": (
        lambda s, d: rg.remove(_sizes(s, d), table(s, d, "part").filter("p_retailprice > 1200").select(F.col("p_partkey").alias("idx"))),
        "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, CAST(p_size AS BIGINT) AS v FROM part WHERE NOT p_retailprice > 1200",
    ),
    "range_join": (
        lambda s, d: rg.concatenated(_sizes(s, d), table(s, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").cast("long").alias("v")), table(s, d, "part").count()),
        f"SELECT idx, v FROM {_P} UNION ALL SELECT s_suppkey + (SELECT count(*) FROM part), CAST(s_nationkey AS BIGINT) FROM supplier",
    ),
    "index_complement": (
        lambda s, d: rg.complement(s, _sizes(s, d).filter("v > 10").select("idx"), 0, table(s, d, "part").count()),
        f"SELECT i AS idx FROM range((SELECT count(*) FROM part)) t(i) WHERE i NOT IN (SELECT idx FROM {_P} WHERE v > 10)",
    ),
    "sorted_intersection": (
        lambda s, d: rg.ordered_intersection(_sizes(s, d), s.range(10, 30).select(F.col("id").alias("v"))).select("idx", "v"),
        f"SELECT idx, v FROM {_P} WHERE v BETWEEN 10 AND 29",
    ),
    "sorted_intersection_first": (
        lambda s, d: rg.ordered_intersection(_sizes(s, d), s.range(10, 30).select(F.col("id").alias("v")), most=25).select("idx", "v"),
        f"SELECT idx, v FROM {_P} WHERE v BETWEEN 10 AND 29 ORDER BY idx LIMIT 25",
    ),
    "subset_test": (
        lambda s, d: rg.is_subset(table(s, d, "lineitem").select(F.col("l_suppkey").alias("k")), table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), "k"),
        "SELECT count(*) = 0 AS subset, count(*) AS n_missing FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) WHERE k NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    ),
    "linear_index": (
        lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id")).select(
            "id", *[c.alias(n) for c, n in zip(rg.from_linear(F.col("id"), [1 << 40, 5, 6]), "ijk", strict=True)], rg.to_linear(rg.from_linear(F.col("id"), [1 << 40, 5, 6]), [1 << 40, 5, 6]).alias("back")
        ),
        "SELECT p_partkey AS id, p_partkey // 30 AS i, (p_partkey // 6) % 5 AS j, p_partkey % 6 AS k, p_partkey AS back FROM part",
    ),
    "weighted_choice": (
        lambda s, d: rg.weighted_choice(table(s, d, "nation").withColumn("w", (F.col("n_nationkey") % 5 + 1).cast("double")), "w", 0.5, "n_nationkey").select("n_nationkey", "n_name"),
        "SELECT n_nationkey, n_name FROM (SELECT *, sum(n_nationkey % 5 + 1) OVER (ORDER BY n_nationkey) AS run, sum(n_nationkey % 5 + 1) OVER () AS total FROM nation) WHERE run > 0.5 * total ORDER BY run LIMIT 1",
    ),
}
