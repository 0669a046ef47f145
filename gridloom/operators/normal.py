"""Normal products A^T A in square blocks: what is dealt are A's entries, not the product's terms.

A row (i, j, row, col, val) of a block table is the block of the columns i * BLOCK and j * BLOCK
on: its entries' places in the block, 16 bits each, and their values. A row of A is sent once to
each pair of column blocks that it has entries in, and its terms are summed where it arrives; so
what a local product shuffles grows with the entries of A and of the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .solvers import _whole_rows

BLOCK = 1024
#: Rows of A that are dealt together, and those whose terms for a block one task sums.
STRETCH, SUMMED = 4096, 65536
#: Terms that are summed at once.
TERMS = 1 << 20

BLOCKS = "i long, j long, row binary, col binary, val binary"
_SIDES = "l_row binary, l_col binary, l_val binary, r_row binary, r_col binary, r_val binary"


def _row(i: int, j: int, block: np.ndarray) -> tuple:
    p, q = np.nonzero(block)
    return i, j, p.astype(np.uint16).tobytes(), q.astype(np.uint16).tobytes(), block[p, q].tobytes()


def places(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a block's entries."""
    return np.frombuffer(r.row, np.uint16), np.frombuffer(r.col, np.uint16), np.frombuffer(r.val)


def dense(r) -> np.ndarray:
    out = np.zeros((BLOCK, BLOCK))
    p, q, val = places(r)
    out[p, q] = val
    return out


def _dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of whole rows as pairs of column blocks, i <= j: the entries of both sides, of rows that have both."""
    for f in _whole_rows(frames):
        row, col, val = f["row"].to_numpy(np.int64), f["col"].to_numpy(np.int64), f["val"].to_numpy(float)
        block, stretch, out = col // BLOCK, row // SUMMED, []
        for s in np.unique(stretch):
            sides = {}
            for b in np.unique(block[stretch == s]):
                at = np.flatnonzero((stretch == s) & (block == b))
                sides[int(b)] = (row[at], (col[at] % BLOCK).astype(np.uint16), val[at])
            packed = lambda side, at: [x[at].tobytes() for x in ((side[0] - s * SUMMED).astype(np.int32), side[1], side[2])]  # noqa: B023, E731
            for i, left in sides.items():
                every = np.ones(len(left[0]), bool)
                out.append((int(s), i, i, *packed(left, every), *packed(left, ~every)))
                for j, right in sides.items():
                    if i < j and (at := np.isin(left[0], right[0])).any():
                        out.append((int(s), i, j, *packed(left, at), *packed(right, np.isin(right[0], left[0]))))
        yield pd.DataFrame(out, columns=["s", "i", "j", *[c.split()[0] for c in _SIDES.split(", ")]])


def _terms(block: np.ndarray, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> None:
    """Adds the terms of rows that both sides have, in one order: sides are rows, columns and values."""
    starts = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    first, own = starts(right[0]), starts(left[0])
    met = np.diff(np.append(first, len(right[0])))
    of = np.repeat(np.arange(len(own)), np.diff(np.append(own, len(left[0]))))
    ends = np.cumsum(met[of])
    flat, lo = block.ravel(), 0
    while lo < len(of):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + TERMS, "right")))
        n = met[of[lo:hi]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[of[lo:hi]], n)
        np.add.at(flat, np.repeat(left[1][lo:hi].astype(np.int64) * BLOCK, n) + right[1][at], np.repeat(left[2][lo:hi], n) * right[2][at])
        lo = hi


def product(a: DataFrame, n: int, alpha: float = 1.0, shift: float = 0.0) -> DataFrame:
    """The blocks of alpha A^T A + shift I for entries (row, col, val) of n columns; an entry may be stored as several rows that add up."""

    def multiply(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _, i, j = map(int, key)
        block = np.zeros((BLOCK, BLOCK))
        for r in f.itertuples(index=False):
            left = np.frombuffer(r.l_row, np.int32), np.frombuffer(r.l_col, np.uint16), np.frombuffer(r.l_val)
            _terms(block, left, left if i == j else (np.frombuffer(r.r_row, np.int32), np.frombuffer(r.r_col, np.uint16), np.frombuffer(r.r_val)))
        return pd.DataFrame([_row(i, j, block)] + ([_row(j, i, block.T)] if i < j else []), columns=["i", "j", "row", "col", "val"])

    def total(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        i, j = map(int, key)
        block = np.zeros((BLOCK, BLOCK))
        for r in f.itertuples(index=False):
            p, q, val = places(r)
            block[p, q] += val
        block *= alpha
        if i == j and shift:
            own = np.arange(min(BLOCK, n - i * BLOCK))
            block[own, own] += shift
        return pd.DataFrame([_row(i, j, block)], columns=["i", "j", "row", "col", "val"])

    used = a.filter("row IS NOT NULL AND col IS NOT NULL AND val IS NOT NULL").select("row", "col", F.col("val").cast("double").alias("val"))
    dealt = used.repartition(F.floor(F.col("row") / STRETCH)).sortWithinPartitions("row").mapInPandas(_dealt, "s long, i long, j long, " + _SIDES)
    parts = dealt.groupBy("s", "i", "j").applyInPandas(multiply, BLOCKS)
    if shift:
        nothing = [F.lit(b"").alias(c) for c in ("row", "col", "val")]
        parts = parts.unionByName(a.sparkSession.range(-(-n // BLOCK)).select(F.col("id").alias("i"), F.col("id").alias("j"), *nothing))
    # A number given keeps adaptive execution from joining partitions: those who read the blocks hold a partition's at once.
    spread = parts.repartition(-(-int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4), "i", "j")
    return cut_lineage(spread.groupBy("i", "j").applyInPandas(total, BLOCKS))


def asymmetry(blocks: DataFrame) -> DataFrame:
    """One row: the greatest |a_ij - a_ji|; 0 of a symmetric matrix."""

    def off(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((BLOCK, BLOCK))
        for r in f.itertuples(index=False):
            p, q, val = places(r)
            if r.i <= r.j:
                block[p, q] += val
            if r.i >= r.j:
                block[q, p] -= val
        return pd.DataFrame({"off": [np.abs(block).max()]})

    met = blocks.groupBy(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).applyInPandas(off, "off double")
    return met.agg(F.coalesce(F.max("off"), F.lit(0.0)).alias("asymmetry"))
