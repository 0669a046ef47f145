"""Writers of matrices, point data and experiment records. Each writes with Spark's writers, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_triplets(a: DataFrame, base: str) -> None:
    """row;col;val lines."""
    a.select("row", "col", "val").write.mode("overwrite").option("sep", ";").csv(base)


def write_vtk(points: DataFrame, path: str, vector: str = "v", title: str = "points") -> None:
    """points(id, x, <vector>) as an ASCII unstructured grid of points with a vector each.

    The format is one text with the points before the vectors, so lines are range-sorted by
    (section, id) and their files, in the order of their names, are that text.
    """
    n = points.count()
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    head = ["# vtk DataFile Version 3.0", title, "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double"]
    middle = [f"POINT_DATA {n}", f"VECTORS {vector} double"]
    fixed = points.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(2, i, x) for i, x in enumerate(middle)], "s int, id long, value string")
    lines = fixed.unionByName(points.select(F.lit(1).alias("s"), "id", joined("x").alias("value"))).unionByName(points.select(F.lit(3).alias("s"), "id", joined(vector).alias("value")))
    lines.repartitionByRange("s", "id").sortWithinPartitions("s", "id").select("value").write.mode("overwrite").text(path)


def append_record(record: DataFrame, path: str) -> None:
    """Rows of an experiment appended to a ;-separated table with a header in each file."""
    record.write.mode("append").option("sep", ";").option("header", True).csv(path)


def write_vector(x: DataFrame, path: str) -> None:
    x.orderBy("idx").select("v").write.mode("overwrite").csv(path)


def write_matrix_rows(rows: DataFrame, path: str, separator: str = ",") -> None:
    """rows(x array) as lines of numbers."""
    rows.select(F.array_join(F.transform("x", lambda v: v.cast("string")), separator).alias("value")).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], folder: str, overwrite: bool = False) -> None:
    """Arrays, trees, block tables and attributes of a computation, each as a Parquet table of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/{name}")


def xml_of(values: dict[str, str], root: str = "config") -> str:
    """A configuration as XML, the last part of each dotted path as an attribute."""
    import xml.etree.ElementTree as ET

    top = ET.Element(root)
    for path, value in sorted(values.items()):
        *parts, attribute = path.split(".")
        node = top
        for p in parts:
            found = node.find(p)
            node = ET.SubElement(node, p) if found is None else found
        node.set(attribute, str(value))
    return ET.tostring(top, encoding="unicode")
