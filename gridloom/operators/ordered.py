"""Order-dependent operators: truncation ranks, selections, top k of each key, stencil cuts, lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def truncation_rank(sigmas: DataFrame, eps: float, frobenius: bool = False, relative: bool = True) -> DataFrame:
    """(key, rank) of each block's singular values sigmas(key, ord, sigma), falling from ord 0.

    Euclidean: the leading values above eps (times the first). Frobenius: the shortest list whose
    tail has a sum of squares of at most eps^2 (times the total).
    """
    if frobenius:
        # From the last value up: a frame without an end would be summed anew for each row.
        tail = F.sum(F.col("sigma") * F.col("sigma")).over(W.partitionBy("key").orderBy(F.desc("ord")).rowsBetween(W.unboundedPreceding, 0))
        total = F.sum(F.col("sigma") * F.col("sigma")).over(W.partitionBy("key"))
        kept = tail > (F.lit(eps * eps) * total if relative else F.lit(eps * eps))
    else:
        first = F.max("sigma").over(W.partitionBy("key"))
        kept = F.col("sigma") > (F.lit(eps) * first if relative else F.lit(eps))
    return sigmas.withColumn("_kept", kept).groupBy("key").agg(F.count_if("_kept").alias("rank"))


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).filter(F.col("ord") < k)


def shrink_stencil(neighbours: DataFrame, n: int) -> DataFrame:
    """The first n of each neighbour list."""
    return neighbours.filter(F.col("ord") < n)


def select_values(values: DataFrame, rule: str, k: int) -> DataFrame:
    """(ord, id, re, im) of k complex values by rule: largest or smallest of magnitude, real, imaginary part or algebraic value, or both ends.

    both_ends goes largest, smallest, second largest, second smallest.
    """
    magnitude = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    measures = {"magn": magnitude, "real": F.col("re"), "imag": F.abs("im"), "alge": F.col("re")}
    if rule == "both_ends":
        top = values.orderBy(F.desc("re"), "id").limit(k)
        low = values.orderBy("re", "id").limit(k)
        a = top.withColumn("ord", 2 * (F.row_number().over(W.orderBy(F.desc("re"), "id")) - 1))
        b = low.withColumn("ord", 2 * (F.row_number().over(W.orderBy("re", "id")) - 1) + 1)
        return a.unionByName(b).filter(F.col("ord") < k).select("ord", "id", "re", "im")
    end, _, measure = rule.partition("_")
    by = measures[measure]
    order = [by.desc() if end == "largest" else by.asc(), F.col("id")]
    top = values.orderBy(*order).limit(k)
    return top.withColumn("ord", F.row_number().over(W.orderBy(*order)) - 1).select("ord", "id", "re", "im")


def lagged(df: DataFrame, key: str, order: str, value: str, steps: int) -> DataFrame:
    """`df` with the previous `steps` values of its series as an array, the latest first; only full histories."""
    w = W.partitionBy(key).orderBy(order)
    before = [F.lag(value, i).over(w) for i in range(1, steps + 1)]
    return df.withColumn("history", F.array(*before)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > steps).drop("_n")


def pivot_row(entries: DataFrame, column: int) -> DataFrame:
    """The row of the entry of greatest magnitude in a column, the first of equals: the pivot of a cross approximation."""
    return entries.filter(F.col("col") == column).orderBy(F.desc(F.abs("val")), "row").limit(1).select("row", "val")


def history_durations(checkpoints: DataFrame) -> DataFrame:
    """(run, label, lap, total): time since the previous checkpoint and since the first; checkpoints(run, label, t)."""
    w = W.partitionBy("run").orderBy("t", "label")
    return checkpoints.select("run", "label", (F.col("t") - F.coalesce(F.lag("t").over(w), F.col("t"))).alias("lap"), (F.col("t") - F.min("t").over(W.partitionBy("run"))).alias("total"))
