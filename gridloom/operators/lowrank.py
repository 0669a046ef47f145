"""Low-rank and hierarchical arithmetic on tables of blocks.

An H-matrix is a table of its leaf blocks: (r_node, c_node, rows, cols, kind, a,
b), with a dense block in `a`, or factors with block = a b^T. Blocks are
independent, so building, truncating, adding and applying them are grouped
passes; recursion only happens along the tree, one join for each level.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_for(sigma: np.ndarray, eps: float, frobenius: bool = False, relative: bool = True) -> int:
    """Euclidean: values above eps (times the first). Frobenius: the shortest list whose tail squares sum to eps^2 (times all) at most."""
    if not len(sigma):
        return 0
    if frobenius:
        tails = np.cumsum((sigma * sigma)[::-1])[::-1]
        return int((tails > eps * eps * (tails[0] if relative else 1.0)).sum())
    return int((sigma > eps * (sigma[0] if relative else 1.0)).sum())


def truncate(a: np.ndarray, b: np.ndarray, eps: float, **mode) -> tuple[np.ndarray, np.ndarray]:
    """The factors of a b^T cut to the rank that eps asks for: QR of both, SVD of the core."""
    qa, ra = np.linalg.qr(a)
    qb, rb = np.linalg.qr(b)
    u, s, vt = np.linalg.svd(ra @ rb.T)
    k = rank_for(s, eps, **mode)
    return qa @ (u[:, :k] * s[:k]), qb @ vt[:k].T


def truncated_sum(parts: list[tuple[np.ndarray, np.ndarray]], eps: float, **mode) -> tuple[np.ndarray, np.ndarray]:
    """The sum of low-rank terms, truncated once."""
    return truncate(np.column_stack([a for a, _ in parts]), np.column_stack([b for _, b in parts]), eps, **mode)


def randomized(apply: Callable, apply_t: Callable, n_cols: int, eps: float, step: int = 8, most: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Factors of a block given by its products: Gaussian probes until a fresh one adds less than eps."""
    rng = np.random.default_rng(seed)
    q = np.zeros((len(apply(np.zeros(n_cols))), 0))
    first = None
    while q.shape[1] < most:
        y = np.column_stack([apply(rng.standard_normal(n_cols)) for _ in range(step)])
        first = first or np.linalg.norm(y, axis=0).max()
        y = y - q @ (q.T @ y)
        if np.linalg.norm(y, axis=0).max() <= eps * first:
            break
        u, s, _ = np.linalg.svd(y - q @ (q.T @ y), full_matrices=False)
        q = np.column_stack([q, u[:, s > 1e-14 * max(s[0], 1e-300)]])
    return truncate(q, np.column_stack([apply_t(c) for c in q.T]) if q.shape[1] else np.zeros((n_cols, 0)), eps) if q.shape[1] else (q, np.zeros((n_cols, 0)))


#: Rows that are looked at before a cross approximation ends.
PROBES = 8


def cross_approximation(entry_row: Callable, entry_col: Callable, n_rows: int, n_cols: int, eps: float, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Partially pivoted: starts at the middle row, the next row is where the last column is greatest.

    A small cross may only mean that its row is well approximated already, so PROBES rows
    spread over the block must be so too before it stops.
    """
    residual = lambda i: entry_row(i) - sum((u[i] * w for u, w in zip(us, vs, strict=True)), np.zeros(n_cols))
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    i, used, first = n_rows // 2, set(), None
    for _ in range(min(most, n_rows, n_cols)):
        used.add(i)
        v = residual(i)
        j = int(np.abs(v).argmax())
        if abs(v[j]) < 1e-300:
            free = [k for k in range(n_rows) if k not in used]
            if not free:
                break
            i = free[0]
            continue
        v = v / v[j]
        u = entry_col(j) - sum((w * x[j] for w, x in zip(us, vs, strict=True)), np.zeros(n_rows))
        us.append(u)
        vs.append(v)
        size = np.linalg.norm(u) * np.linalg.norm(v)
        first = first or size
        if size <= eps * first:
            spread = [int(k) for k in np.linspace(0, n_rows - 1, PROBES).round() if int(k) not in used]
            worse = [k for k in spread if np.linalg.norm(residual(k)) * np.sqrt(n_rows) > eps * first]
            if not worse:
                break
            i = worse[0]
            continue
        order = np.argsort(-np.abs(u))
        i = next((int(k) for k in order if int(k) not in used), i)
    return np.column_stack(us) if us else np.zeros((n_rows, 0)), np.column_stack(vs) if vs else np.zeros((n_cols, 0))


_BLOCKS = "r_node long, c_node long, rows array<long>, cols array<long>, kind string, rank int, a binary, b binary"


def build(points: DataFrame, blocks: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], eps: float, spread: bool = False) -> DataFrame:
    """The H-matrix of a kernel over points(id, node, x) and leaf blocks(r_node, c_node, admissible); nodes are leaves of the tree or their ancestors.

    The points of a cluster are found by the prefix of their leaf's number; each block is one group.
    spread: for dear kernels, blocks are dealt to all shuffle partitions, which adaptive execution would join by their bytes.
    """
    own = points.select("id", "x", F.explode(F.expr("transform(sequence(0, CAST(floor(log2(node)) AS INT)), d -> shiftright(node, d))")).alias("n"))
    leaves = blocks.filter("leaf")
    # Only clusters that a block names are gathered, so never all points unless one block has them all.
    named = lambda s: leaves.select(F.col(f"{s}_node").alias("n")).distinct()
    side = lambda s: own.join(named(s), "n", "left_semi").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias(f"{s}_points"))
    joined = leaves.join(side("r"), leaves["r_node"] == F.col("n")).drop("n").join(side("c"), F.col("c_node") == F.col("n")).drop("n")
    if spread:
        joined = joined.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "r_node", "c_node")

    def run(frames):
        for f in frames:
            out = []
            for b in f.itertuples(index=False):
                x, y = np.array([p["x"] for p in b.r_points]), np.array([p["x"] for p in b.c_points])
                rows, cols = [p["id"] for p in b.r_points], [p["id"] for p in b.c_points]
                if b.admissible:
                    u, v = cross_approximation(lambda i: kernel(x[i : i + 1], y)[0], lambda j: kernel(x, y[j : j + 1])[:, 0], len(x), len(y), eps)  # noqa: B023
                    u, v = truncate(u, v, eps) if u.shape[1] else (u, v)
                    out.append((b.r_node, b.c_node, rows, cols, "lowrank", u.shape[1], u.tobytes(), v.tobytes()))
                else:
                    out.append((b.r_node, b.c_node, rows, cols, "dense", min(len(x), len(y)), np.ascontiguousarray(kernel(x, y)).tobytes(), b""))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _BLOCKS.split(", ")])

    return joined.mapInPandas(run, _BLOCKS)


def h_matvec(blocks: DataFrame, x: DataFrame) -> DataFrame:
    """(idx, v) of an H-matrix times x(idx, v): each block gets its part of x by a join, products never form a b^T."""
    # Its column lists are read apart from its factors: kept on disk, so that kernels are evaluated once.
    blocks = blocks.persist(StorageLevel.DISK_ONLY)
    blocks.count()
    need = blocks.select("r_node", "c_node", F.posexplode("cols").alias("at", "idx")).join(x, "idx")
    parts = need.groupBy("r_node", "c_node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("x"))

    def run(frames):
        for f in frames:
            out = []
            for b in f.itertuples(index=False):
                v = np.asarray(b.x, float)
                if b.kind == "dense":
                    y = np.frombuffer(b.a).reshape(len(b.rows), len(v)) @ v
                else:
                    y = np.frombuffer(b.a).reshape(len(b.rows), -1) @ (np.frombuffer(b.b).reshape(len(v), -1).T @ v) if b.rank else np.zeros(len(b.rows))
                out.append(pd.DataFrame({"idx": np.asarray(b.rows, np.int64), "v": y}))
            if out:
                yield pd.concat(out)

    return blocks.join(parts, ["r_node", "c_node"]).mapInPandas(run, "idx long, v double").groupBy("idx").agg(F.sum("v").alias("v"))


def storage(blocks: DataFrame) -> DataFrame:
    """One row: bytes of dense and of low-rank blocks, blocks, and the greatest rank."""
    size = F.length("a").cast("long") + F.length("b")
    return blocks.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "dense", size)), F.lit(0)).alias("dense_bytes"),
        F.coalesce(F.sum(F.when(F.col("kind") != "dense", size)), F.lit(0)).alias("lowrank_bytes"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.max(F.when(F.col("kind") != "dense", F.col("rank"))).alias("max_rank"),
    )


def dense_size() -> Column:
    """Bytes of a block's entries as a dense block; a block over 16384 points a side has more than an integer counts."""
    return F.lit(8).cast("long") * F.size("rows") * F.size("cols")


def recompress(blocks: DataFrame, eps: float) -> DataFrame:
    """All low-rank blocks truncated again."""

    def run(frames):
        for f in frames:
            for i in f.index[f["kind"] == "lowrank"]:
                m, n, k = len(f.at[i, "rows"]), len(f.at[i, "cols"]), int(f.at[i, "rank"])
                if k:
                    u, v = truncate(np.frombuffer(f.at[i, "a"]).reshape(m, k), np.frombuffer(f.at[i, "b"]).reshape(n, k), eps)
                    f.at[i, "a"], f.at[i, "b"], f.at[i, "rank"] = u.tobytes(), v.tobytes(), u.shape[1]
            yield f

    return blocks.mapInPandas(run, _BLOCKS)


def add(one: DataFrame, other: DataFrame, eps: float) -> DataFrame:
    """The sum of two H-matrices over the same blocks; low-rank terms of a block are collected and truncated once."""
    both = one.unionByName(other)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        first = f.iloc[0].copy()
        m, n = len(first["rows"]), len(first["cols"])
        if first["kind"] == "dense":
            first["a"] = sum(np.frombuffer(x).reshape(m, n) for x in f["a"]).tobytes()
        else:
            u, v = truncated_sum([(np.frombuffer(r.a).reshape(m, r.rank), np.frombuffer(r.b).reshape(n, r.rank)) for r in f.itertuples()], eps)
            first["a"], first["b"], first["rank"] = u.tobytes(), v.tobytes(), u.shape[1]
        return pd.DataFrame([first])

    return both.groupBy("r_node", "c_node").applyInPandas(run, _BLOCKS)


def scale(blocks: DataFrame, alpha: float) -> DataFrame:
    """alpha times an H-matrix: dense blocks, and one factor of the others."""

    def run(frames):
        for f in frames:
            f["a"] = [(alpha * np.frombuffer(x)).tobytes() for x in f["a"]]
            yield f

    return blocks.mapInPandas(run, _BLOCKS)
