"""Sparse linear algebra on coordinate tables (row, col, val) and vectors (idx, v).

Every operator is a declarative plan: products are equi-joins followed by sums,
so partial aggregation runs before the shuffle and the optimiser picks the join.
An entry that is absent is zero; an entry may be stored as several rows that add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inner indexes of a product that are dealt together.
STRETCH = 4096


def coo(df: DataFrame, row: str | Column, col: str | Column, val: str | Column) -> DataFrame:
    """A coordinate table with one row for each entry: duplicates are summed."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(row).alias("row"), as_col(col).alias("col"), as_col(val).alias("val")).groupBy("row", "col").agg(F.sum("val").alias("val"))


def pattern(a: DataFrame) -> DataFrame:
    """The distinct positions of a matrix."""
    return a.select("row", "col").distinct()


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def scale(a: DataFrame, alpha: float) -> DataFrame:
    return a.withColumn("val", F.col("val") * F.lit(alpha))


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0) -> DataFrame:
    """b + alpha * a, on the union of both patterns."""
    return scale(a, alpha).unionByName(b).groupBy("row", "col").agg(F.sum("val").alias("val"))


def identity(spark, n: int, alpha: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(float(alpha)).alias("val"))


def spmv(a: DataFrame, x: DataFrame, alpha: float = 1.0, transposed: bool = False) -> DataFrame:
    """alpha * A x, or alpha * A^T x: (idx, v) with the rows that have entries."""
    over, out = ("row", "col") if transposed else ("col", "row")
    joined = a.join(x.select(F.col("idx").alias(over), "v"), over)
    return joined.groupBy(F.col(out).alias("idx")).agg((F.sum(F.col("val") * F.col("v")) * F.lit(alpha)).alias("v"))


def spmm(a: DataFrame, b: DataFrame, a_transposed: bool = False) -> DataFrame:
    """A B or A^T B: the entries of both that have an inner index meet, and their terms are summed.

    Inner indexes are dealt in stretches, so terms of nearby ones, which in local matrices fall on the same
    entries, are summed in their task before the shuffle.
    """
    out, inner = ("col", "row") if a_transposed else ("row", "col")
    empty = lambda name: F.lit(None).cast(f"struct<{name}: bigint, val: double>")
    one = lambda name, key, as_: F.struct(F.col(key).cast("long").alias(name), F.col(as_).cast("double").alias("val"))
    left = a.select(F.col(inner).alias("k"), one("row", out, "val").alias("l"), empty("col").alias("r"))
    right = b.select(F.col("row").alias("k"), empty("row").alias("l"), one("col", "col", "val").alias("r"))
    dealt = left.unionByName(right).filter("k IS NOT NULL").withColumn("_s", F.floor(F.col("k") / STRETCH)).repartition("_s")
    met = dealt.groupBy("_s", "k").agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r")).filter((F.size("l") > 0) & (F.size("r") > 0))
    terms = met.select("r", F.explode("l").alias("l")).select("l", F.explode("r").alias("r"))
    return terms.groupBy(F.col("l.row").alias("row"), F.col("r.col").alias("col")).agg(F.sum(F.col("l.val") * F.col("r.val")).alias("val"))


def axpy(x: DataFrame, y: DataFrame, alpha: float = 1.0) -> DataFrame:
    """y + alpha * x."""
    return x.select("idx", (F.col("v") * F.lit(alpha)).alias("v")).unionByName(y).groupBy("idx").agg(F.sum("v").alias("v"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    joined = x.join(y.select("idx", F.col("v").alias("_y")), "idx")
    return joined.agg(F.coalesce(F.sum(F.col("v") * F.col("_y")), F.lit(0.0)).alias("dot"))


def norms(x: DataFrame, v: str = "v") -> DataFrame:
    """Squared Euclidean norm and maximum norm of a vector, or of a matrix's entries (its Frobenius norm)."""
    return x.agg(F.sum(F.col(v) * F.col(v)).alias("norm2_sq"), F.max(F.abs(v)).alias("norm_inf"))


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("row").agg(F.sum("val").alias("row_sum"), F.count(F.lit(1)).alias("n_entries"))


def block_slice(a: DataFrame, row0: int, col0: int, n_rows: int, n_cols: int) -> DataFrame:
    """The block at (row0, col0), indexed from 0; the range filter reaches the scan."""
    inside = F.col("row").between(row0, row0 + n_rows - 1) & F.col("col").between(col0, col0 + n_cols - 1)
    return a.filter(inside).select((F.col("row") - row0).alias("row"), (F.col("col") - col0).alias("col"), "val")


def block_insert(a: DataFrame, b: DataFrame, row0: int, col0: int) -> DataFrame:
    """A with B placed at (row0, col0); B's positions must be free in A."""
    moved = b.select((F.col("row") + row0).alias("row"), (F.col("col") + col0).alias("col"), "val")
    return a.unionByName(moved)


def triangle(a: DataFrame, lower: bool = True, strict: bool = False) -> DataFrame:
    row, col = F.col("row"), F.col("col")
    keep = {(True, False): row >= col, (True, True): row > col, (False, False): row <= col, (False, True): row < col}[lower, strict]
    return a.filter(keep)


def diagonal(a: DataFrame) -> DataFrame:
    return a.filter(F.col("row") == F.col("col")).select(F.col("row").alias("idx"), F.col("val").alias("v"))


def permute(a: DataFrame, perm: DataFrame) -> DataFrame:
    """Rows and columns moved by perm(pos, idx): the entry of index idx goes to pos."""
    rows = perm.select(F.col("idx").alias("row"), F.col("pos").alias("_r"))
    cols = perm.select(F.col("idx").alias("col"), F.col("pos").alias("_c"))
    return a.join(rows, "row").join(cols, "col").select(F.col("_r").alias("row"), F.col("_c").alias("col"), "val")


def eliminate(a: DataFrame, fixed: DataFrame) -> DataFrame:
    """Rows and columns of the fixed unknowns dropped; fixed(idx, ...)."""
    gone = fixed.select("idx").distinct()
    return a.join(gone, F.col("row") == F.col("idx"), "left_anti").join(gone, F.col("col") == F.col("idx"), "left_anti")


def rhs_correction(a: DataFrame, rhs: DataFrame, known: DataFrame) -> DataFrame:
    """rhs on the free unknowns minus A[free, fixed] * known(idx, v)."""
    coupled = spmv(a, known, alpha=-1.0)
    both = rhs.unionByName(coupled).join(known.select("idx"), "idx", "left_anti")
    return both.groupBy("idx").agg(F.sum("v").alias("v"))


def relative_errors(x: DataFrame, reference: DataFrame) -> DataFrame:
    """Relative Euclidean and absolute maximum error of x against the reference."""
    joined = reference.select("idx", F.col("v").alias("_r")).join(x, "idx", "left").withColumn("_d", F.coalesce("v", F.lit(0.0)) - F.col("_r"))
    return joined.agg(
        F.sqrt(F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col("_r") * F.col("_r"))).alias("rel_l2"),
        F.max(F.abs("_d")).alias("abs_linf"),
    )


def asymmetry(a: DataFrame) -> DataFrame:
    """One row: the greatest |a_ij - a_ji|; 0 of a symmetric matrix."""
    return add(a, transpose(a), -1.0).agg(F.coalesce(F.max(F.abs("val")), F.lit(0.0)).alias("asymmetry"))


def orthogonality(a: DataFrame, n: int) -> DataFrame:
    """One row: the Frobenius norm of A^T A - I."""
    return add(identity(a.sparkSession, n), spmm(a, a, a_transposed=True), -1.0).agg(F.sqrt(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0))).alias("defect"))


def diagonal_first(a: DataFrame) -> DataFrame:
    """(row, ord, col, val): each row's entries by column, but the diagonal one first."""
    from pyspark.sql import Window as W

    order = W.partitionBy("row").orderBy((F.col("row") != F.col("col")).cast("int"), "col")
    return a.select("row", (F.row_number().over(order) - 1).alias("ord"), "col", "val")


def sorted_by(df: DataFrame, key: str, value: str, less) -> DataFrame:
    """(key, value array) of each group in the order of a comparator: less(a, b) is a Column that tells whether a comes first."""
    order = lambda a, b: F.when(less(a, b), -1).when(less(b, a), 1).otherwise(0)
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value), order).alias(value))


def from_csr(rows: DataFrame) -> DataFrame:
    """(row, col, val) of rows(row, cols, vals); as_csr is the way back."""
    return rows.select("row", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("row", F.col("e.cols").alias("col"), F.col("e.vals").alias("val"))


def as_csr(a: DataFrame) -> DataFrame:
    listed = a.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("e"))
    return listed.select("row", F.transform("e", lambda x: x["col"]).alias("cols"), F.transform("e", lambda x: x["val"]).alias("vals"))
