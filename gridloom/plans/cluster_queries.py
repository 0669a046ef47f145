"""Queries over cluster trees, block trees and admissibility of parts by (size, price) and of lineitem as a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..session import cut_lineage, table

AXES = ["x", "y"]
LEVELS, LEAF = 3, 50


def points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


#: Levels that node numbers of 64 bits allow; bisection ends before, when all leaves have their size.
ALL_LEVELS = 62


def _bisected(s, d, levels=LEVELS):
    return cl.bisect(points(s, d), AXES, LEAF, levels)


def _nodes(s, d, levels=LEVELS):
    return cl.tree(_bisected(s, d, levels), AXES)


def _levels() -> str:
    out = "n0 AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(1 AS BIGINT) AS node FROM part)"
    for i in range(LEVELS):
        out += f""", b{i} AS (SELECT node, count(*) AS n, max(x) - min(x) AS ex, max(y) - min(y) AS ey, (max(x) + min(x)) * 0.5 AS mx, (max(y) + min(y)) * 0.5 AS my FROM n{i} WHERE node >= {1 << i} GROUP BY node),
        n{i + 1} AS (SELECT id, x, y, CASE WHEN b.node IS NULL OR n <= {LEAF} OR greatest(ex, ey) <= 0 THEN p.node
            ELSE 2 * p.node + CASE WHEN ex >= ey THEN CASE WHEN x >= mx THEN 1 ELSE 0 END ELSE CASE WHEN y >= my THEN 1 ELSE 0 END END END AS node FROM n{i} p LEFT JOIN b{i} b USING (node))"""
    return out


_T = f"""{_levels()}, leaves AS (SELECT * FROM n{LEVELS}),
t AS (SELECT node >> k AS node, count(*) AS size, bool_or(k = 0) AS leaf, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y
      FROM leaves, range({LEVELS + 1}) r(k) WHERE node >> k > 0 GROUP BY node >> k)"""
_GAP = "(greatest(0, r.min_x - c.max_x, c.min_x - r.max_x) ** 2 + greatest(0, r.min_y - c.max_y, c.min_y - r.max_y) ** 2)"
_DR = "((r.max_x - r.min_x) ** 2 + (r.max_y - r.min_y) ** 2)"
_DC = _DR.replace("r.", "c.")
_ADM = {
    "two_min": f"least({_DR}, {_DC}) <= {_GAP}",
    "two": f"greatest({_DR}, {_DC}) <= {_GAP}",
    "maximum": "greatest(r.max_x - r.min_x, r.max_y - r.min_y, c.max_x - c.min_x, c.max_y - c.min_y) <= greatest(0, r.min_x - c.max_x, c.min_x - r.max_x, r.min_y - c.max_y, c.min_y - r.max_y)",
    "two_min_strict": f"least({_DR}, {_DC}) < {_GAP}",
    "distant": f"{_GAP} > 0",
    "sphere": f"sqrt(((r.max_x + r.min_x) * 0.5 - (c.max_x + c.min_x) * 0.5) ** 2 + ((r.max_y + r.min_y) * 0.5 - (c.max_y + c.min_y) * 0.5) ** 2) > 0.5 * (sqrt({_DR}) + sqrt({_DC}))",
    "hodlr": "r.node <> c.node",
}


def _admissible(kind: str, levels: int = LEVELS):
    def run(s, d):
        leaves = cut_lineage(_nodes(s, d, levels).filter("leaf").select("node", "min_x", "max_x", "min_y", "max_y"))
        return cl.dealt_pairs(leaves, leaves).filter(cl.admissible(kind, AXES, 1.0)).select("r_node", "c_node")

    return run, f"WITH {_T} SELECT r.node AS r_node, c.node AS c_node FROM t r, t c WHERE r.leaf AND c.leaf AND {_ADM[kind]}"


def _block_sql(test: str = _ADM["two_min"]) -> str:
    out = f"WITH {_T}, p0 AS (SELECT r.node AS r, c.node AS c, r.leaf AS rl, c.leaf AS cl, {test} AS adm FROM t r, t c WHERE r.node = 1 AND c.node = 1)"
    for i in range(1, LEVELS + 1):
        out += f", p{i} AS (SELECT r.node AS r, c.node AS c, r.leaf AS rl, c.leaf AS cl, {test} AS adm FROM p{i - 1} p JOIN t r ON r.node >> 1 = p.r JOIN t c ON c.node >> 1 = p.c WHERE NOT (adm OR rl OR cl))"
    every = " UNION ALL ".join(f"SELECT r AS r_node, c AS c_node, {i} AS level, adm AS admissible, adm OR rl OR cl AS leaf FROM p{i}" for i in range(LEVELS + 1))
    return out + f", blocks AS ({every})"


def _blocks(s, d, levels=LEVELS):
    return cl.block_tree(_nodes(s, d, levels), AXES, "two_min", 1.0)


def _binned(s, d):
    """Orders by customers as a sparse matrix in blocks of 100 by 100, and the blocks' extents."""
    o = table(s, d, "orders")
    a = o.select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("col"), F.floor(F.col("o_orderkey") / 100).alias("br"), F.floor(F.col("o_custkey") / 100).alias("bc"))
    rows = o.groupBy(F.floor(F.col("o_orderkey") / 100).alias("br")).agg(F.count(F.lit(1)).alias("m"))
    cols = table(s, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("bc")).agg(F.count(F.lit(1)).alias("n"))
    return a, rows, cols


def _sparse_sql(measure: str) -> str:
    return f"""WITH f AS (SELECT o_orderkey AS row, o_custkey AS col, o_orderkey // 100 AS br, o_custkey // 100 AS bc FROM orders),
        m AS (SELECT o_orderkey // 100 AS br, count(*) AS m FROM orders GROUP BY 1), n AS (SELECT c_custkey // 100 AS bc, count(*) AS n FROM customer GROUP BY 1),
        c AS (SELECT br, bc, {measure} AS measure FROM f GROUP BY br, bc)
        SELECT br, bc, measure, (m * n) // (2 * (m + n)) AS "limit", measure < (m * n) // (2 * (m + n)) AND measure <= 8 AS admissible FROM c JOIN m USING (br) JOIN n USING (bc)"""


QUERIES = {
    "bisection_cluster_L3": (lambda s, d: _bisected(s, d).select("id", "node"), f"WITH {_levels()} SELECT id, node FROM n{LEVELS}"),
    "cluster_tree": (lambda s, d: _nodes(s, d).select("node", "size", "leaf", "min_x", "max_x", "min_y", "max_y"), f"WITH {_T} SELECT * FROM t"),
    "tree_depth": (
        lambda s, d: cl.tree_stats(_nodes(s, d)),
        f"WITH {_T}, l AS (SELECT *, CAST(floor(log2(node)) AS INT) AS level FROM t) SELECT count(*) AS n_nodes, count(*) FILTER (leaf) AS n_leaves, max(level) AS depth, min(level) FILTER (leaf) AS min_depth, min(size) FILTER (leaf) AS min_leaf, max(size) FILTER (leaf) AS max_leaf FROM l",
    ),
    **{f"admissible_pairs_{kind}": _admissible(kind) for kind in _ADM},
    "block_tree": (lambda s, d: _blocks(s, d), _block_sql() + " SELECT * FROM blocks"),
    "sparsity_constant": (
        lambda s, d: cl.sparsity_constant(_blocks(s, d)),
        _block_sql() + ", r AS (SELECT count(*) AS n FROM blocks WHERE leaf GROUP BY r_node), c AS (SELECT count(*) AS n FROM blocks WHERE leaf GROUP BY c_node) SELECT (SELECT max(n) FROM r) AS csp_r, (SELECT max(n) FROM c) AS csp_c, greatest((SELECT max(n) FROM r), (SELECT max(n) FROM c)) AS csp",
    ),
    # The same of the whole tree, bisected until no leaf is over LEAF points; the SQL of those above unrolls LEVELS levels.
    "cluster_tree_whole": (lambda s, d: _nodes(s, d, ALL_LEVELS).select("node", "size", "leaf", "min_x", "max_x", "min_y", "max_y"), None),
    "tree_depth_whole": (lambda s, d: cl.tree_stats(_nodes(s, d, ALL_LEVELS)), None),
    **{f"admissible_pairs_{kind}_whole": (_admissible(kind, ALL_LEVELS)[0], None) for kind in _ADM},
    "block_tree_whole": (lambda s, d: _blocks(s, d, ALL_LEVELS), None),
    "sparsity_constant_whole": (lambda s, d: cl.sparsity_constant(_blocks(s, d, ALL_LEVELS)), None),
    "block_tree_predicate": (
        lambda s, d: cl.block_tree(_nodes(s, d), AXES, (F.col("r_node") > F.col("c_node")) & (F.col("r_node") > 3)),
        _block_sql("(r.node > c.node AND r.node > 3)") + " SELECT * FROM blocks",
    ),
    "tree_cut": (
        lambda s, d: cl.cut_to_depth(_nodes(s, d), 2).select("node", "size", "leaf", "level"),
        f"WITH {_T} SELECT node, size, leaf OR node >= 4 AS leaf, floor(log2(node))::INT AS level FROM t WHERE node < 8",
    ),
    "tree_extended": (
        lambda s, d: cl.balanced(_nodes(s, d), 5).select("node", F.coalesce("parent", F.lit(-1)).alias("parent"), "size", "leaf", "level"),
        f"""WITH {_T}, l AS (SELECT node, size, leaf, floor(log2(node))::INT AS level FROM t), e AS (SELECT node, size, false AS leaf, level FROM l UNION ALL SELECT node << k, size, level + k = 5, level + k FROM l, range(1, 6) r(k) WHERE leaf AND level + k <= 5)
            SELECT node, coalesce(nullif(node >> 1, 0), -1) AS parent, size, leaf, level::INT AS level FROM e""",
    ),
    "tree_without_small": (
        lambda s, d: cl.without_small(_nodes(s, d), table(s, d, "part").count() // 8).select("node", "size", "leaf"),
        f"""WITH {_T}, bad AS (SELECT DISTINCT node >> 1 AS p FROM t WHERE node > 1 AND size < (SELECT count(*) // 8 FROM part))
            SELECT node, size, leaf OR node IN (SELECT p FROM bad) AS leaf FROM t WHERE NOT EXISTS (SELECT 1 FROM bad, range(1, 5) r(k) WHERE t.node >> k = bad.p)""",
    ),
    "admissible_sparse_row_col": (lambda s, d: cl.sparse_admissible(*_binned(s, d), 8), _sparse_sql("least(count(DISTINCT row), count(DISTINCT col))")),
    "admissible_sparse_nnz": (lambda s, d: cl.sparse_admissible(*_binned(s, d), 8, by_count=True), _sparse_sql("count(*)")),
    "renumber_partition": (
        lambda s, d: cl.renumber(points(s, d).withColumn("part", F.col("id") % 3), "part", ["id"]).select("id", "part", "pos"),
        "SELECT p_partkey AS id, p_partkey % 3 AS part, row_number() OVER (ORDER BY p_partkey % 3, p_partkey) - 1 AS pos FROM part",
    ),
}
