"""Incremental state over streams: matrices and point indexes that grow by micro-batches.

The engine's operators are batch operators; a stream of entries or of insertions
and removals is applied to them by foreachBatch, which Spark retries by batch
number, so a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def assembled(stream: DataFrame) -> DataFrame:
    """A running (row, col, val) sum of a stream of entries, for output mode complete or update."""
    return stream.groupBy("row", "col").agg(F.sum("val").alias("val"))


def windowed_norms(stream: DataFrame, time: str, value: str, window: str, late: str) -> DataFrame:
    """Sum of squares, greatest magnitude and count in event-time windows; rows later than `late` are dropped."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"))
        .agg(F.sum(F.col(value) * F.col(value)).alias("norm2_sq"), F.max(F.abs(value)).alias("norm_inf"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "norm2_sq", "norm_inf", "n")
    )


def log_changes(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of point changes (id, x, op) with op insert or remove, kept by batch under `folder`."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_points(changes: DataFrame) -> DataFrame:
    """(id, x) of the points whose last change isn't a removal; ids never change."""
    last = changes.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("batch"), F.desc("op")))).filter("_r = 1")
    return last.filter("op = 'insert'").select("id", "x")
