"""Domain decomposition of scattered points: neighbour graph, clusters, and the blocks of the graph's matrix.

For whoever discretizes on scattered nodes and solves by blocks: the stencils of all
nodes make up a sparse matrix, clusters of nodes its block rows and columns, and for
each block it must be known whether it may be kept as a product of thin factors.

    python -m jobs.neighbour_blocks SOURCE TARGET [--config FILE]

SOURCE has points with an id and coordinates, one array column or several numbers,
in any format that Spark reads by name. What is written, each time anew:

TARGET/nodes/cluster=C         id, its position when clusters stand one after the
                               other, how many neighbours it is linked with, and
                               whether one of them is in another cluster (Parquet)
TARGET/entries/row_cluster=R   the matrix by positions, with col_cluster (ORC)
TARGET/blocks                  of each block: entries, distinct rows and columns, the
                               limit of its rank, and whether it is admissible (CSV)

The graph links each node with its nearest ones, both ways; clusters come from cutting
boxes in the middle of their longest side, by the axes named, until they have at most
leaf_size points or `levels` cuts are made. A block is admissible if the lesser of
its numbers of distinct rows and columns stays below half the harmonic bound of its
extents, and is at most most_rank. The same input gives the same result.

Points that are null or lack a coordinate are left out, and counted in the log; of
rows that repeat an id the one with the smallest coordinates stays.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import cluster, spatial

from .common import config, log, log_to_stderr

DEFAULTS = {"format": "parquet", "id": "vec_id", "coordinates": ["embedding"], "neighbours": 6, "cluster_axes": [0, 1], "leaf_size": 50, "levels": 3, "most_rank": 20}
_log = log("neighbour_blocks")
_OPTIONS = {"csv": {"header": True, "inferSchema": True}}


def points(spark: SparkSession, source: str, settings: dict) -> DataFrame:
    """(id, x) of each point, and null for x where a coordinate is missing."""
    read = spark.read.format(settings["format"]).options(**_OPTIONS.get(settings["format"], {})).load(source)
    columns = settings["coordinates"]
    x = F.col(columns[0]).cast("array<double>") if len(columns) == 1 and "array" in read.schema[columns[0]].dataType.simpleString() else F.array(*[F.col(c).cast("double") for c in columns])
    whole = F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v)), x)
    return read.select(F.col(settings["id"]).cast("long").alias("id"), whole.alias("x"))


def run(spark: SparkSession, source: str, target: str, settings: dict | None = None) -> dict[str, int]:
    """Write the tables and return counts of what was read and written."""
    settings = DEFAULTS | (settings or {})
    found = points(spark, source, settings)
    usable = found.filter(F.col("id").isNotNull() & F.col("x").isNotNull()).groupBy("id").agg(F.min("x").alias("x"))
    seen, n = found.count(), usable.count()
    _log.info("read %d rows of %s, %d points", seen, source, n)

    graph = spatial.symmetric_graph(spatial.knn(usable, usable, settings["neighbours"]))
    axes = {f"a{k}": F.col("x")[k] for k in settings["cluster_axes"]}
    placed = cluster.bisect(usable.select("id", *[c.alias(a) for a, c in axes.items()]), list(axes), settings["leaf_size"], settings["levels"])
    numbered = cluster.renumber(placed.select("id", F.col("node").alias("cluster")), "cluster", ["id"])
    numbered.write.mode("overwrite").parquet(f"{target}/numbers")
    numbers = spark.read.schema("id long, cluster long, pos long").parquet(f"{target}/numbers")

    side = lambda name, own: numbers.select(F.col("id").alias(own), F.col("cluster").alias(f"{name}_cluster"), F.col("pos").alias(name))
    entries = graph.join(side("row", "src"), "src").join(side("col", "dst"), "dst").select("row", "col", F.col("w").cast("double").alias("val"), "col_cluster", "row_cluster")
    entries.repartition("row_cluster", "col_cluster").write.mode("overwrite").partitionBy("row_cluster").orc(f"{target}/entries")
    entries = spark.read.schema("row long, col long, val double, col_cluster long, row_cluster long").orc(f"{target}/entries")

    linked = entries.groupBy(F.col("row").alias("pos")).agg(F.count(F.lit(1)).alias("n_linked"), F.bool_or(F.col("row_cluster") != F.col("col_cluster")).alias("interface"))
    nodes = numbers.join(linked, "pos", "left").select("id", "pos", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("interface", F.lit(False)).alias("interface"), "cluster")
    nodes.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{target}/nodes")

    sizes = lambda own, n: numbers.groupBy(F.col("cluster").alias(own)).agg(F.count(F.lit(1)).alias(n))
    named = entries.select(F.col("row_cluster").alias("br"), F.col("col_cluster").alias("bc"), "row", "col")
    judged = cluster.sparse_admissible(named, sizes("br", "m"), sizes("bc", "n"), settings["most_rank"])
    counted = named.groupBy("br", "bc").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_cols"))
    blocks = counted.join(judged, ["br", "bc"]).select(F.col("br").alias("row_cluster"), F.col("bc").alias("col_cluster"), "n_entries", "n_rows", "n_cols", F.col("limit").alias("rank_limit"), "admissible")
    blocks.coalesce(1).sortWithinPartitions("row_cluster", "col_cluster").write.mode("overwrite").option("header", True).csv(f"{target}/blocks")  # a row for each pair of clusters that meet

    done = {"rows": seen, "points": n, "entries": entries.count(), "clusters": numbers.select("cluster").distinct().count(), "blocks": read_blocks(spark, target).count()}
    _log.info("wrote %(points)d nodes in %(clusters)d clusters, %(entries)d entries in %(blocks)d blocks to %(target)s", done | {"target": target})
    return done


def read_blocks(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("row_cluster long, col_cluster long, n_entries long, n_rows long, n_cols long, rank_limit long, admissible boolean").option("header", True).csv(f"{target}/blocks")


def output(spark: SparkSession, target: str) -> DataFrame:
    """What stands in the three tables, a row for each of theirs.

    node:  its cluster, position (row), id (col), number of links (n), and whether it is at an interface (flag)
    entry: its clusters, positions, value (n), and whether it couples two clusters (flag)
    block: its clusters, distinct rows and columns, entries (n), rank limit, and whether it is admissible (flag)
    """
    nodes = spark.read.schema("id long, pos long, n_linked long, interface boolean, cluster long").parquet(f"{target}/nodes")
    entries = spark.read.schema("row long, col long, val double, col_cluster long, row_cluster long").orc(f"{target}/entries")
    none = F.lit(0).cast("long").alias("rank_limit")
    parts = (
        nodes.select(F.lit("node").alias("part"), F.col("cluster").alias("row_cluster"), F.col("cluster").alias("col_cluster"), F.col("pos").alias("row"), F.col("id").alias("col"), F.col("n_linked").alias("n"), none, F.col("interface").alias("flag")),
        entries.select(F.lit("entry").alias("part"), "row_cluster", "col_cluster", "row", "col", F.col("val").cast("long").alias("n"), none, (F.col("row_cluster") != F.col("col_cluster")).alias("flag")),
        read_blocks(spark, target).select(F.lit("block").alias("part"), "row_cluster", "col_cluster", F.col("n_rows").alias("row"), F.col("n_cols").alias("col"), F.col("n_entries").alias("n"), "rank_limit", F.col("admissible").alias("flag")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def main() -> None:
    parser = argparse.ArgumentParser(description="Neighbour graph, clusters and matrix blocks of scattered points.")
    for name in ("source", "target"):
        parser.add_argument(name)
    parser.add_argument("--config")
    args = parser.parse_args()
    log_to_stderr()
    spark = SparkSession.builder.appName("neighbour_blocks").getOrCreate()
    try:
        run(spark, args.source, args.target, config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
