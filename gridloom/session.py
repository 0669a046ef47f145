"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="gridloom-")


def clean_driver(spark: SparkSession) -> None:
    """Collect the driver JVM's garbage: Spark drops broadcasts, shuffles and checkpoints only once they are collected, and the heap gives back what it no longer holds.

    For jobs of many stages: a driver with a large heap otherwise keeps what all of them left behind.
    """
    spark._jvm.System.gc()


#: Shuffle partitions of a small table that go to one file.
COMPACT = 16

#: Bits of an estimated size in bytes from which it says nothing about the table.
NO_SIZE = 60


def cut_lineage(df: DataFrame, partitions_per_file: int = 0, compact: bool = False, sized: bool = True) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and return it without its lineage.

    The folder is shared_folder's. The files are reliable checkpoints, so a lost
    executor costs nothing but a re-read.

    A checkpoint keeps the planner's estimate of its size, and a join's is the product of
    both sides'. Where a loop joins a table with what was made of it, the estimate's digits
    would double in each round until they fill the driver, so absurd ones are dropped.

    partitions_per_file: for a narrow plan that makes a compact row of each large
    one, so many input partitions go to a file; else their files would be many
    and tiny.
    compact: for a table that comes out of a shuffle and is small beside the input
    (counts, keys, links); it is dealt to COMPACT times fewer files than there are
    shuffle partitions.
    sized=False: drops the estimate in any case, for rows that are many more bytes than
    what the planner reads (exploded ones, or a file of few distinct values), which it
    would broadcast; adaptive execution goes by the real size.
    """
    spark = df.sparkSession
    if compact:
        df = df.repartition(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // COMPACT))
    if partitions_per_file and (n := df.rdd.getNumPartitions()) > partitions_per_file:
        df = df.repartition(-(-n // partitions_per_file))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    absurd = not sized or df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() > NO_SIZE
    kept = df.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), spark) if absurd else kept


#: Pieces of one generation that a Pieces holds before it writes them as one of the next.
PIECES = 8


class Pieces:
    """A table that grows piece by piece: PIECES of them are written as one, so neither plans nor files grow with the rounds but by their logarithm."""

    def __init__(self):
        self.kept: list[tuple[int, DataFrame]] = []

    def add(self, piece: DataFrame) -> None:
        """Takes a checkpointed piece."""
        self.kept.append((0, piece))
        while len(last := [p for rank, p in self.kept[-PIECES:] if rank == self.kept[-1][0]]) == PIECES:
            rank = self.kept[-1][0] + 1
            del self.kept[-PIECES:]
            self.kept.append((rank, cut_lineage(_united(last).coalesce(int(piece.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))

    def table(self) -> DataFrame:
        return _united([p for _, p in self.kept])


def _united(pieces: list[DataFrame]) -> DataFrame:
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out
