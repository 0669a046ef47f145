"""Readers of geometry, matrix and configuration files. All go through Spark's readers, so any store works."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of the lines of a file, or of a folder's files by name, that aren't blank or comments, from 0.

    A split knows where it begins in its file and reads its lines in order, so lines are counted by split and numbered where they are read.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.trim(F.regexp_replace("value", "\r$", "")).alias("line"))
    told = text.filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("_i", F.monotonically_increasing_id())
    splits = told.groupBy("_f", "_s").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_f", "_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cut_lineage(splits.select("_f", "_s", "_first", before.alias("_start")), compact=True)
    return cut_lineage(told.join(F.broadcast(starts), ["_f", "_s"]).select((F.col("_i") - F.col("_first") + F.col("_start")).alias("n"), "line"))


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices(id, x) and faces(id, v, colour) of a polyhedron in OFF form; colour is null where there is none."""
    ordered = _lines(spark, path)
    head = ordered.filter("n < 2").orderBy("n").collect()
    if not head or not head[0]["line"].upper().startswith("OFF"):
        raise ValueError(f"{path} has no OFF header")
    counts = head[0]["line"].split()[1:] or head[1]["line"].split()
    skip = 1 if len(head[0]["line"].split()) > 1 else 2
    n_v, n_f = int(counts[0]), int(counts[1])
    parts = ordered.withColumn("t", F.split("line", r"\s+"))
    vertices = parts.filter(F.col("n").between(skip, skip + n_v - 1)).select((F.col("n") - skip).cast("long").alias("id"), F.transform(F.slice("t", 1, 3), lambda c: c.try_cast("double")).alias("x"))
    size = F.expr("try_cast(get(t, 0) AS INT)")
    faces = parts.filter(F.col("n").between(skip + n_v, skip + n_v + n_f - 1)).select(
        (F.col("n") - skip - n_v).cast("long").alias("id"),
        F.transform(F.slice("t", F.lit(2), size), lambda c: c.try_cast("long")).alias("v"),
        F.when(F.size("t") >= size + 4, F.transform(F.slice("t", size + 2, F.lit(3)), lambda c: c.try_cast("int"))).alias("colour"),
    )
    return vertices, faces


def face_edges(faces: DataFrame) -> DataFrame:
    """(face, ord, a, b, sign): the edges of each face; an edge has its smaller vertex first, sign -1 where the face runs against it."""
    e = faces.select(F.col("id").alias("face"), F.posexplode("v").alias("ord", "p"), F.col("v"), F.size("v").alias("n"))
    q = F.element_at("v", ((F.col("ord") + 1) % F.col("n") + 1).cast("int"))
    return e.withColumn("q", q).select("face", "ord", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), 1).otherwise(-1).alias("sign"))


def parse_stl(contents: DataFrame) -> DataFrame:
    """(file, id, normal, p1, p2, p3, attribute) of the binary STL contents(path, content): an 80-byte header, a count, 50 bytes for each triangle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record = np.dtype([("f", "<f4", (4, 3)), ("attribute", "<u2")])
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                (n,) = struct.unpack_from("<I", content, 80)
                if len(content) < 84 + 50 * n:
                    raise ValueError(f"{name} ends before its {n} triangles")
                t = np.frombuffer(content, record, n, 84)
                corner = lambda i: list(t["f"][:, i].astype(float))  # noqa: B023, E731
                yield pd.DataFrame({"file": name, "id": np.arange(n), "normal": corner(0), "p1": corner(1), "p2": corner(2), "p3": corner(3), "attribute": t["attribute"].astype("int32")})

    a = "array<double>"
    return contents.select("path", "content").mapInPandas(run, f"file string, id long, normal {a}, p1 {a}, p2 {a}, p3 {a}, attribute int")


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """The triangles of binary STL files, as parse_stl gives them."""
    return parse_stl(spark.read.format("binaryFile").load(path))


def read_csv_vector(spark: SparkSession, path: str) -> DataFrame:
    """(v) one number a line; text that isn't a number is an error."""
    return spark.read.schema("v double").option("mode", "FAILFAST").csv(path)


def read_csv_matrix(spark: SparkSession, path: str, width: int, separator: str = ",") -> DataFrame:
    """(x) rows of `width` numbers; ragged rows and bad numbers are errors."""
    cells = spark.read.text(path).select(F.split("value", "\\Q" + separator + "\\E", -1).alias("c"))
    checked = F.when(F.size("c") == width, F.col("c")).otherwise(F.raise_error(F.lit(f"a row doesn't have {width} cells")).cast("array<string>"))
    return cells.select(F.transform(checked, lambda c: F.trim(c).cast("double")).alias("x"))  # strict casts: bad numbers fail


def read_xml_config(spark: SparkSession, path: str) -> dict[str, str]:
    """Attributes and texts of a configuration file by dotted path, as a.b.attribute. A configuration is small, so it ends on the driver."""
    import xml.etree.ElementTree as ET

    text = spark.read.text(path, wholetext=True).first()["value"]
    found: dict[str, str] = {}

    def walk(node: ET.Element, at: str) -> None:
        for key, value in node.attrib.items():
            found[f"{at}.{key}" if at else key] = value
        if node.text and node.text.strip():
            found[at] = node.text.strip()
        for child in node:
            walk(child, f"{at}.{child.tag}" if at else child.tag)

    walk(ET.fromstring(text), "")
    return found


def read_triplets(spark: SparkSession, base: str) -> DataFrame:
    """(row, col, val) of a matrix written by sinks.write_triplets."""
    return spark.read.schema("row long, col long, val double").option("sep", ";").csv(base)


def parameter(spark: SparkSession, name: str, default, env: str | None = None):
    """A parameter of the session's settings (gridloom.<name>), else the environment, else the default, in the default's type."""
    import os

    value = spark.conf.get(f"gridloom.{name}", None) or (os.environ.get(env) if env else None)
    return default if value is None else type(default)(value)
