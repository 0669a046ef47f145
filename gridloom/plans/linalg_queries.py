"""Queries over sparse matrices built from lineitem: parts by suppliers, quantities summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linalg as la
from ..session import table

_A = "(SELECT l_partkey AS row, l_suppkey AS col, CAST(sum(l_quantity) AS DOUBLE) AS val FROM lineitem GROUP BY l_partkey, l_suppkey)"
_X = "(SELECT s_suppkey AS idx, CAST(s_suppkey + 1 AS DOUBLE) AS v FROM supplier)"
_P = "(SELECT p_partkey AS idx, CAST(p_size AS DOUBLE) AS v FROM part)"


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return la.coo(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), (F.col("s_suppkey") + 1).cast("double").alias("v"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("v"))


def n_suppliers(spark: SparkSession, d: str) -> int:
    return table(spark, d, "supplier").count()


def square(spark: SparkSession, d: str) -> DataFrame:
    """A square matrix of all of lineitem: suppliers by part keys modulo the number of suppliers."""
    n = n_suppliers(spark, d)
    return la.coo(table(spark, d, "lineitem"), F.col("l_suppkey"), F.col("l_partkey") % n, F.col("l_quantity"))


_SQ = "(SELECT l_suppkey AS row, l_partkey % (SELECT count(*) FROM supplier) AS col, CAST(sum(l_quantity) AS DOUBLE) AS val FROM lineitem GROUP BY 1, 2)"


def _permutation(spark: SparkSession, d: str) -> DataFrame:
    n = n_suppliers(spark, d)
    return spark.range(n).select(F.col("id").alias("pos"), ((F.col("id") * 37 + 11) % n).alias("idx"))


def _boundary(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in debt, as the fixed unknowns."""
    return table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("idx"), (F.col("s_suppkey") + 1).cast("double").alias("v"))


_PERM = "(SELECT i AS pos, (i * 37 + 11) % (SELECT count(*) FROM supplier) AS idx FROM range((SELECT count(*) FROM supplier)) t(i))"
_B = "(SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"

QUERIES = {
    "spmv": (
        lambda s, d: la.spmv(matrix(s, d), suppliers(s, d)),
        f"SELECT a.row AS idx, sum(a.val * x.v) AS v FROM {_A} a JOIN {_X} x ON a.col = x.idx GROUP BY a.row",
    ),
    "spmv_transpose": (
        lambda s, d: la.spmv(matrix(s, d), parts(s, d), alpha=2.0, transposed=True),
        f"SELECT a.col AS idx, 2.0::DOUBLE * sum(a.val * x.v) AS v FROM {_A} a JOIN {_P} x ON a.row = x.idx GROUP BY a.col",
    ),
    "coo_assemble_dupsum": (lambda s, d: matrix(s, d), f"SELECT * FROM {_A}"),
    "sparse_pattern_distinct": (
        lambda s, d: la.pattern(table(s, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"))),
        "SELECT DISTINCT l_partkey AS row, l_suppkey AS col FROM lineitem",
    ),
    "spmm": (
        lambda s, d: la.spmm(matrix(s, d), matrix(s, d), a_transposed=True),
        f"SELECT a.col AS row, b.col AS col, sum(a.val * b.val) AS val FROM {_A} a JOIN {_A} b ON a.row = b.row GROUP BY a.col, b.col",
    ),
    "matrix_add_scaled": (
        lambda s, d: la.add(square(s, d), la.identity(s, n_suppliers(s, d)), alpha=0.5),
        f"SELECT row, col, sum(val) AS val FROM (SELECT row, col, val * 0.5::DOUBLE AS val FROM {_SQ} UNION ALL SELECT s_suppkey, s_suppkey, 1.0::DOUBLE FROM supplier) GROUP BY row, col",
    ),
    "matrix_scale": (lambda s, d: la.scale(matrix(s, d), 0.25), f"SELECT row, col, val * 0.25::DOUBLE AS val FROM {_A}"),
    "matrix_transpose": (lambda s, d: la.transpose(matrix(s, d)), f"SELECT col AS row, row AS col, val FROM {_A}"),
    "matrix_identity": (lambda s, d: la.identity(s, n_suppliers(s, d), 3.0), "SELECT s_suppkey AS row, s_suppkey AS col, 3.0::DOUBLE AS val FROM supplier"),
    "block_slice": (
        lambda s, d: la.block_slice(matrix(s, d), 50, 10, 100, 40),
        f"SELECT row - 50 AS row, col - 10 AS col, val FROM {_A} WHERE row BETWEEN 50 AND 149 AND col BETWEEN 10 AND 49",
    ),
    "block_insert": (
        lambda s, d: la.block_insert(square(s, d), la.identity(s, 10), n_suppliers(s, d), n_suppliers(s, d)),
        f"SELECT row, col, val FROM {_SQ} UNION ALL SELECT i + (SELECT count(*) FROM supplier), i + (SELECT count(*) FROM supplier), 1.0::DOUBLE FROM range(10) t(i)",
    ),
    "lower_triangle": (lambda s, d: la.triangle(square(s, d)), f"SELECT * FROM {_SQ} WHERE row >= col"),
    "upper_triangle_strict": (lambda s, d: la.triangle(square(s, d), lower=False, strict=True), f"SELECT * FROM {_SQ} WHERE row < col"),
    "matrix_diagonal": (lambda s, d: la.diagonal(square(s, d)), f"SELECT row AS idx, val AS v FROM {_SQ} WHERE row = col"),
    "dot": (
        lambda s, d: la.dot(la.spmv(matrix(s, d), suppliers(s, d)), parts(s, d)),
        f"SELECT sum(y.v * p.v) AS dot FROM (SELECT a.row AS idx, sum(a.val * x.v) AS v FROM {_A} a JOIN {_X} x ON a.col = x.idx GROUP BY a.row) y JOIN {_P} p USING (idx)",
    ),
    "axpy": (
        lambda s, d: la.axpy(suppliers(s, d), parts(s, d), alpha=-2.0),
        f"SELECT idx, sum(v) AS v FROM (SELECT idx, -2.0::DOUBLE * v AS v FROM {_X} UNION ALL SELECT * FROM {_P}) GROUP BY idx",
    ),
    "vector_norms": (lambda s, d: la.norms(parts(s, d)), f"SELECT sum(v * v) AS norm2_sq, max(abs(v)) AS norm_inf FROM {_P}"),
    "frobenius_sq": (lambda s, d: la.norms(matrix(s, d), "val"), f"SELECT sum(val * val) AS norm2_sq, max(abs(val)) AS norm_inf FROM {_A}"),
    "row_sums": (lambda s, d: la.row_sums(matrix(s, d)), f"SELECT row, sum(val) AS row_sum, count(*) AS n_entries FROM {_A} GROUP BY row"),
    "dirichlet_eliminate": (
        lambda s, d: la.eliminate(square(s, d), _boundary(s, d)),
        f"SELECT * FROM {_SQ} WHERE row NOT IN {_B} AND col NOT IN {_B}",
    ),
    "rhs_correction": (
        lambda s, d: la.rhs_correction(square(s, d), suppliers(s, d), _boundary(s, d)),
        f"""SELECT x.idx, x.v - coalesce(c.v, 0) AS v FROM {_X} x
            LEFT JOIN (SELECT a.row AS idx, sum(a.val * x.v) AS v FROM {_SQ} a JOIN {_X} x ON a.col = x.idx WHERE x.idx IN {_B} GROUP BY a.row) c USING (idx)
            WHERE x.idx NOT IN {_B}""",
    ),
    "permute_coo": (
        lambda s, d: la.permute(square(s, d), _permutation(s, d)),
        f"SELECT r.pos AS row, c.pos AS col, val FROM {_SQ} a JOIN {_PERM} r ON a.row = r.idx JOIN {_PERM} c ON a.col = c.idx",
    ),
    "relative_error_norms": (
        lambda s, d: la.relative_errors(la.scale(parts(s, d).withColumnRenamed("v", "val"), 1.25).withColumnRenamed("val", "v"), parts(s, d)).select(
            F.round("rel_l2", 6).alias("rel_l2"), F.round("abs_linf", 6).alias("abs_linf")
        ),
        f"SELECT round(sqrt(sum(pow(v * 1.25 - v, 2)) / sum(v * v)), 6) AS rel_l2, round(max(abs(v * 1.25 - v)), 6) AS abs_linf FROM {_P}",
    ),
    "saddle_matvec": (
        # [A G; D C] on (u, p): A square, G its columns of suppliers in debt, D their transpose, C the identity.
        lambda s, d: _saddle(s, d),
        f"""WITH n AS (SELECT count(*) AS n FROM supplier), a AS (SELECT * FROM {_SQ}), x AS (SELECT * FROM {_X})
            SELECT idx, sum(v) AS v FROM (
              SELECT a.row AS idx, a.val * x.v AS v FROM a JOIN x ON a.col = x.idx
              UNION ALL SELECT a.row, a.val * x.v FROM a JOIN x ON a.col = x.idx WHERE a.col IN {_B}
              UNION ALL SELECT a.col + n, a.val * x.v FROM a JOIN x ON a.row = x.idx, n WHERE a.col IN {_B}
              UNION ALL SELECT idx + n, v FROM x, n WHERE idx IN {_B}) GROUP BY idx""",
    ),
}


def _saddle(spark: SparkSession, d: str) -> DataFrame:
    a, n, fixed = square(spark, d), n_suppliers(spark, d), _boundary(spark, d)
    g = a.join(fixed.select(F.col("idx").alias("col")), "col", "left_semi").select("row", "col", "val")
    moved = fixed.select((F.col("idx") + n).alias("idx"), "v")
    c = moved.select(F.col("idx").alias("row"), F.col("idx").alias("col"), F.lit(1.0).alias("val"))
    d_block = la.transpose(g).select((F.col("row") + n).alias("row"), "col", "val")
    whole = la.block_insert(a, g, 0, n).unionByName(d_block).unionByName(c)
    return la.spmv(whole, suppliers(spark, d).unionByName(moved))
