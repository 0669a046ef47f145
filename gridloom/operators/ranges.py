"""Index sets and positional lists: (pos, v) tables with half-open sequences, filters that give indexes, gathers and scatters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seq(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> DataFrame:
    """idx from start up to, not including, stop; seq(n) counts from 0."""
    start, stop = (0, start) if stop is None else (start, stop)
    return spark.range(start, stop, step).select(F.col("id").alias("idx"))


def linspace(spark: SparkSession, begin: float, end: float, count: int, include_end: bool = True) -> DataFrame:
    """(idx, v) of a uniform grid."""
    intervals = max(1, count - 1 if include_end else count)
    return spark.range(count).select(F.col("id").alias("idx"), (F.lit(float(begin)) + F.col("id") * F.lit((end - begin) / intervals)).alias("v"))


def grid(spark: SparkSession, begin: list[float], end: list[float], counts: list[int], include_end: list[bool] | None = None) -> DataFrame:
    """(id, x) of a uniform grid in any dimension, the last axis running fastest; by index arithmetic on one range."""
    total = 1
    for n in counts:
        total *= n
    axes, stride = [], total
    for d, n in enumerate(counts):
        stride //= n
        intervals = max(1, n - 1 if include_end is None or include_end[d] else n)
        axes.append(F.lit(float(begin[d])) + (F.floor(F.col("id") / stride) % n) * F.lit((end[d] - begin[d]) / intervals))
    return spark.range(total).select("id", F.array(*axes).alias("x"))


def filter_indexes(df: DataFrame, predicate: Column, pos: str = "idx") -> DataFrame:
    """The indexes, not the values, of the rows where the predicate holds."""
    return df.filter(predicate).select(pos)


def gather(df: DataFrame, indexes: DataFrame, pos: str = "idx") -> DataFrame:
    """(ord, value columns) for indexes(ord, idx); repeats and order are kept by ord."""
    return indexes.join(df, pos)


def scatter(df: DataFrame, updates: DataFrame, value: str = "v", pos: str = "idx") -> DataFrame:
    """`df` with the values of updates(idx, v) written at their indexes."""
    new = updates.select(pos, F.col(value).alias("_new"))
    return df.join(new, pos, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def remove(df: DataFrame, indexes: DataFrame, pos: str = "idx") -> DataFrame:
    """The listed positions dropped; later elements move down.

    A position's shift is the number of removed positions before it. The removed list,
    not the data, is ranked; the data joins the gap that it lies in.
    """
    gone = indexes.select(pos).distinct()
    kept = df.join(gone, pos, "left_anti")
    return renumbered(kept, pos)


def renumbered(df: DataFrame, pos: str = "idx", width: int = 1 << 16) -> DataFrame:
    """Positions made dense from 0 in their order, without putting all rows in one window.

    Rows are ranked within blocks of `width` positions; the blocks' counts are summed up before.
    """
    blocked = df.withColumn("_b", F.floor(F.col(pos) / width))
    counts = blocked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy(pos)) - 1
    return blocked.withColumn("_rank", rank).join(starts, "_b").withColumn(pos, F.col("_rank") + F.col("_start")).drop("_b", "_rank", "_start")


def concatenated(first: DataFrame, second: DataFrame, n_first: int, pos: str = "idx") -> DataFrame:
    """The second list's positions follow the first's."""
    return first.unionByName(second.withColumn(pos, F.col(pos) + n_first))


def ordered_intersection(first: DataFrame, second: DataFrame, value: str = "v", most: int | None = None, pos: str = "idx") -> DataFrame:
    """Elements of the first list that the second has, in the first's order; at most `most` of them."""
    found = first.join(second.select(value).distinct(), value, "left_semi")
    return found if most is None else found.orderBy(pos).limit(most)


def complement(spark: SparkSession, listed: DataFrame, offset: int, n: int, pos: str = "idx") -> DataFrame:
    """The indexes in [offset, offset + n) that aren't listed."""
    return seq(spark, offset, offset + n).withColumnRenamed("idx", pos).join(listed.select(pos), pos, "left_anti")


def is_subset(part: DataFrame, whole: DataFrame, on: str) -> DataFrame:
    """One row: whether all of `part` is in `whole`, and how many aren't."""
    missing = part.select(on).distinct().join(whole.select(on), on, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    return missing.select((F.col("n_missing") == 0).alias("subset"), "n_missing")


def to_linear(indexes: list[Column], shape: list[int]) -> Column:
    """Row-major linear index."""
    out = F.lit(0).cast("long")
    for i, n in zip(indexes, shape, strict=True):
        out = out * n + i
    return out


def from_linear(linear: Column, shape: list[int]) -> list[Column]:
    out, stride = [], 1
    for n in reversed(shape):
        out.append((F.floor(linear / stride) % n).cast("long"))
        stride *= n
    return out[::-1]


def weighted_choice(df: DataFrame, weight: str, u: float, key: str) -> DataFrame:
    """The row that a uniform number in [0, 1) picks by weight: the first whose running sum exceeds it."""
    total = W.partitionBy()
    running = F.sum(weight).over(W.orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    placed = df.withColumn("_run", running).withColumn("_all", F.sum(weight).over(total))
    return placed.filter(F.col("_run") > F.lit(u) * F.col("_all")).orderBy("_run").limit(1).drop("_run", "_all")
