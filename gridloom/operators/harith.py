"""Arithmetic of tiled low-rank matrices: products, triangular solves, factorizations, inverses.

A matrix is a table of tiles (i, j, m, n, kind, rank, a, b) over clusters numbered
from 0: a dense tile in `a`, or factors with tile = a b^T. Absent tiles are 0.
Products are a join on the inner cluster and one sum for each tile; a factorization
takes one step for each cluster, and each step is a narrow solve of the step's row
and column and a product of them, so only tiles meet in a task. A step's tiles are
materialised in the shared checkpoint folder.

Truncation keeps a relative accuracy `eps` in the Euclidean norm; a tile whose factors
would be larger than itself is kept dense.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lowrank import truncate

TILES = "i long, j long, m int, n int, kind string, rank int, a binary, b binary"
_NAMES = [c.split()[0] for c in TILES.split(", ")]
Tile = np.ndarray | tuple[np.ndarray, np.ndarray]


def _read(kind: str, m: int, n: int, rank: int, a: bytes, b: bytes) -> Tile:
    if kind == "dense":
        return np.frombuffer(a).reshape(m, n)
    return np.frombuffer(a).reshape(m, rank), np.frombuffer(b).reshape(n, rank)


def _row(i: int, j: int, t: Tile, eps: float | None = None) -> tuple:
    """A tile as a row; with eps, truncated and in the smaller of both forms."""
    if eps is not None and i != j:
        u, v = truncate(*t, eps) if isinstance(t, tuple) else truncate(t, np.eye(t.shape[1]), eps)
        m, n = len(u), len(v)
        t = (u, v) if u.shape[1] * (m + n) < m * n else u @ v.T
    if isinstance(t, tuple):
        return i, j, len(t[0]), len(t[1]), "lowrank", t[0].shape[1], np.ascontiguousarray(t[0]).tobytes(), np.ascontiguousarray(t[1]).tobytes()
    return i, j, *t.shape, "dense", min(t.shape), np.ascontiguousarray(t).tobytes(), b""


def full(t: Tile) -> np.ndarray:
    return t[0] @ t[1].T if isinstance(t, tuple) else t


def _product(x: Tile, y: Tile) -> Tile:
    """x y; of low rank if either is."""
    if isinstance(x, tuple):
        return x[0], (y[1] @ (y[0].T @ x[1]) if isinstance(y, tuple) else y.T @ x[1])
    return (x @ y[0], y[1]) if isinstance(y, tuple) else x @ y


def _sum(parts: list[tuple[float, Tile]]) -> Tile:
    """Low-rank terms beside each other; dense if any is."""
    if all(isinstance(t, tuple) for _, t in parts):
        return np.column_stack([c * t[0] for c, t in parts]), np.column_stack([t[1] for _, t in parts])
    return sum(c * full(t) for c, t in parts)


def _tile_of(rows: DataFrame, part: DataFrame, idx: str, side: str) -> DataFrame:
    return rows.join(part.select(F.col("idx").alias(idx), F.col("tile").alias(side), F.col("pos").alias(f"{side}_pos"), F.col("size").alias(f"{side}_size")), idx)


def even_partition(index: DataFrame, size: int) -> DataFrame:
    """(idx, tile, pos, size) of indexes(idx) 0, 1, ... in runs of `size`."""
    dealt = index.select("idx", F.floor(F.col("idx") / size).cast("long").alias("tile"))
    sizes = dealt.groupBy("tile").agg(F.count(F.lit(1)).cast("int").alias("size"), F.min("idx").alias("_first"))
    return dealt.join(sizes, "tile").select("idx", "tile", (F.col("idx") - F.col("_first")).cast("int").alias("pos"), "size")


def from_entries(a: DataFrame, part: DataFrame, eps: float) -> DataFrame:
    """Tiles of entries (row, col, val) over part(idx, tile, pos, size); tiles off the diagonal are compressed."""
    dealt = _tile_of(_tile_of(a, part, "row", "i"), part, "col", "j")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros((int(f["i_size"].iloc[0]), int(f["j_size"].iloc[0])))
        np.add.at(t, (f["i_pos"].to_numpy(), f["j_pos"].to_numpy()), f["val"].to_numpy())
        return pd.DataFrame([_row(*map(int, key), t, eps)], columns=_NAMES)

    return dealt.select("i", "j", "i_pos", "j_pos", "i_size", "j_size", "val").groupBy("i", "j").applyInPandas(run, TILES)


def from_blocks(blocks: DataFrame, size: int, n: int, eps: float) -> DataFrame:
    """Tiles of `size` indexes, which divides a block's, of a table of blocks (normal.product): each block is cut where it lies."""
    from .normal import BLOCK, dense

    each = BLOCK // size
    if each * size != BLOCK:
        raise ValueError(f"tiles of {size} don't divide blocks of {BLOCK}")

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                block = dense(r)
                m, k = (min(BLOCK, n - int(x) * BLOCK) for x in (r.i, r.j))
                for p in range(0, m, size):
                    out = [_row(int(r.i) * each + p // size, int(r.j) * each + q // size, t, eps) for q in range(0, k, size) if (t := block[p : min(p + size, m), q : min(q + size, k)]).any()]
                    if out:
                        yield pd.DataFrame(out, columns=_NAMES)

    return blocks.mapInPandas(run, TILES)


def even_entries(tiles: DataFrame, size: int) -> DataFrame:
    """(row, col, val) of tiles over even runs of the indexes 0, 1, ..., zeros left out."""

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                x = full(_read(r.kind, r.m, r.n, r.rank, r.a, r.b))
                p, q = np.nonzero(x)
                yield pd.DataFrame({"row": p + r.i * size, "col": q + r.j * size, "val": x[p, q]})

    return tiles.mapInPandas(run, "row long, col long, val double")


def entries(tiles: DataFrame, part: DataFrame) -> DataFrame:
    """(row, col, val) of all tiles, zeros left out."""

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                x = full(_read(r.kind, r.m, r.n, r.rank, r.a, r.b))
                p, q = np.nonzero(x)
                yield pd.DataFrame({"i": r.i, "j": r.j, "i_pos": p, "j_pos": q, "val": x[p, q]})

    found = tiles.mapInPandas(run, "i long, j long, i_pos int, j_pos int, val double")
    named = lambda s, name: part.select(F.col("tile").alias(s), F.col("pos").alias(f"{s}_pos"), F.col("idx").alias(name))
    return found.join(named("i", "row"), ["i", "i_pos"]).join(named("j", "col"), ["j", "j_pos"]).select("row", "col", "val")


def _pairs(joined: DataFrame, work: Callable[[Tile, Tile], Tile], schema: str = TILES) -> DataFrame:
    """One tile out of each joined pair of tiles (i, j and x_*, y_*)."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                x, y = _read(r.x_kind, r.x_m, r.x_n, r.x_rank, r.x_a, r.x_b), _read(r.y_kind, r.y_m, r.y_n, r.y_rank, r.y_a, r.y_b)
                out.append(_row(r.i, r.j, work(x, y)))
            yield pd.DataFrame(out, columns=_NAMES)

    return joined.mapInPandas(run, schema)


def _side(tiles: DataFrame, name: str, keys: dict[str, str]) -> DataFrame:
    return tiles.select(*[F.col(k).alias(v) for k, v in keys.items()], *[F.col(c).alias(f"{name}_{c}") for c in ("m", "n", "kind", "rank", "a", "b")])


def products(x: DataFrame, y: DataFrame) -> DataFrame:
    """All terms X_ik Y_kj of a product, unsummed: the matrix they make is their sum (`evaluated`)."""
    return _pairs(_side(x, "x", {"i": "i", "j": "k"}).join(_side(y, "y", {"i": "k", "j": "j"}), "k"), _product)


def evaluated(terms: DataFrame, eps: float, one_by_one: bool = False) -> DataFrame:
    """Tiles summed from terms with a factor (column `c`, 1 if there is none), truncated once or after each addition."""
    c = F.col("c") if "c" in terms.columns else F.lit(1.0)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        parts = [(r.c, _read(r.kind, r.m, r.n, r.rank, r.a, r.b)) for r in f.itertuples(index=False)]
        total = _sum(parts[:1] if one_by_one else parts)
        for p in parts[1:] if one_by_one else []:
            total = _sum([(1.0, total), p])
            if isinstance(total, tuple):
                total = truncate(*total, eps)
        return pd.DataFrame([_row(*map(int, key), total, eps)], columns=_NAMES)

    return terms.select(*_NAMES, c.alias("c")).groupBy("i", "j").applyInPandas(run, TILES)


def multiply_add(z: DataFrame | None, x: DataFrame, y: DataFrame, alpha: float = 1.0, eps: float = 1e-8, form: str = "accumulator") -> DataFrame:
    """Z + alpha X Y. form: `standard` truncates after each term, `accumulator` once, `sum` leaves the terms for `evaluated`."""
    terms = products(x, y).withColumn("c", F.lit(float(alpha)))
    if z is not None:
        terms = z.withColumn("c", F.lit(1.0)).unionByName(terms)
    return terms if form == "sum" else evaluated(terms, eps, form == "standard")


def add(x: DataFrame, y: DataFrame, alpha: float = 1.0, eps: float = 1e-8) -> DataFrame:
    return evaluated(x.withColumn("c", F.lit(1.0)).unionByName(y.withColumn("c", F.lit(float(alpha)))), eps)


def transposed(x: DataFrame) -> DataFrame:
    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                t = _read(r.kind, r.m, r.n, r.rank, r.a, r.b)
                out.append(_row(r.j, r.i, (t[1], t[0]) if isinstance(t, tuple) else t.T))
            yield pd.DataFrame(out, columns=_NAMES)

    return x.mapInPandas(run, TILES)


def _each(tiles: DataFrame, work: Callable[[Tile], Tile]) -> DataFrame:
    def run(frames):
        for f in frames:
            yield pd.DataFrame([_row(r.i, r.j, work(_read(r.kind, r.m, r.n, r.rank, r.a, r.b))) for r in f.itertuples(index=False)], columns=_NAMES)

    return tiles.mapInPandas(run, TILES)


def identity(part: DataFrame) -> DataFrame:
    def run(frames):
        for f in frames:
            yield pd.DataFrame([_row(int(k), int(k), np.eye(int(s))) for k, s in zip(f["tile"], f["size"], strict=True)], columns=_NAMES)

    return part.select("tile", "size").distinct().mapInPandas(run, TILES)


def _left_solved(d: Tile, t: Tile) -> Tile:
    """d^-1 t."""
    return (np.linalg.solve(d, t[0]), t[1]) if isinstance(t, tuple) else np.linalg.solve(d, t)


def _right_solved(d: Tile, t: Tile) -> Tile:
    """t d^-1."""
    return (t[0], np.linalg.solve(d.T, t[1])) if isinstance(t, tuple) else np.linalg.solve(d.T, t.T).T


def _with_diagonal(diagonal: DataFrame, tiles: DataFrame, work: Callable[[Tile, Tile], Tile]) -> DataFrame:
    """work(diagonal tile, tile) for each of `tiles`; there is one diagonal tile, so it is broadcast."""
    one = F.broadcast(_side(diagonal.withColumn("_k", F.lit(1)), "x", {"_k": "_k"}))
    return _pairs(_side(tiles.withColumn("_k", F.lit(1)), "y", {"i": "i", "j": "j", "_k": "_k"}).join(one, "_k"), work)


def _pivoted(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """t = l u with rows of l in the order that pivoting needs."""
    u, p = t.copy(), np.arange(len(t))
    l_ = np.zeros_like(u)
    for k in range(len(u)):
        s = k + int(np.abs(u[k:, k]).argmax())
        u[[k, s]], l_[[k, s]], p[[k, s]] = u[[s, k]], l_[[s, k]], p[[s, k]]
        if u[k, k] == 0:
            raise ZeroDivisionError("a diagonal tile is singular")
        l_[k, k] = 1
        l_[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(l_[k + 1 :, k], u[k])
    out = np.zeros_like(l_)
    out[p] = l_
    return out, np.triu(u)


def lu(tiles: DataFrame, count: int, eps: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Factors L and U with L U = the matrix of `count` clusters; diagonal tiles are pivoted within themselves."""
    now = cut_lineage(tiles)
    lower, upper = [], []
    for k in range(count):
        diagonal = now.filter((F.col("i") == k) & (F.col("j") == k))
        l_k, u_k = cut_lineage(_each(diagonal, lambda t: _pivoted(full(t))[0])), cut_lineage(_each(diagonal, lambda t: _pivoted(full(t))[1]))
        row = cut_lineage(_with_diagonal(l_k, now.filter((F.col("i") == k) & (F.col("j") > k)), _left_solved))
        col = cut_lineage(_with_diagonal(u_k, now.filter((F.col("i") > k) & (F.col("j") == k)), _right_solved))
        lower += [l_k, col]
        upper += [u_k, row]
        if k + 1 < count:
            now = cut_lineage(multiply_add(now.filter((F.col("i") > k) & (F.col("j") > k)), col, row, -1.0, eps))
    return _all(lower), _all(upper)


def cholesky(tiles: DataFrame, count: int, eps: float = 1e-8) -> DataFrame:
    """L with L L^T = the symmetric positive definite matrix; only tiles on and below the diagonal are read."""
    now, lower = cut_lineage(tiles.filter("i >= j")), []
    for k in range(count):
        l_k = cut_lineage(_each(now.filter((F.col("i") == k) & (F.col("j") == k)), lambda t: np.linalg.cholesky(full(t))))
        col = cut_lineage(_with_diagonal(l_k, now.filter((F.col("i") > k) & (F.col("j") == k)), lambda d, t: _right_solved(d.T, t)))
        lower += [l_k, col]
        if k + 1 < count:
            terms = products(col, transposed(col)).filter("i >= j").withColumn("c", F.lit(-1.0))
            now = cut_lineage(evaluated(now.filter(F.col("j") > k).withColumn("c", F.lit(1.0)).unionByName(terms), eps))
    return _all(lower)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def triangular_solve(t: DataFrame, b: DataFrame, count: int, lower: bool = True, eps: float = 1e-8) -> DataFrame:
    """T^-1 B for a triangular T, in tiles: one step for each cluster."""
    now, done = cut_lineage(b), []
    t = cut_lineage(t)
    for k in range(count) if lower else reversed(range(count)):
        row = cut_lineage(_with_diagonal(t.filter((F.col("i") == k) & (F.col("j") == k)), now.filter(F.col("i") == k), _left_solved))
        done.append(row)
        ahead = F.col("i") > k if lower else F.col("i") < k
        now = cut_lineage(multiply_add(now.filter(ahead), t.filter(ahead & (F.col("j") == k)), row, -1.0, eps))
    return _all(done)


def triangular_product(t: DataFrame, b: DataFrame, lower: bool = True, eps: float = 1e-8) -> DataFrame:
    """T B, of the triangle of T alone."""
    return multiply_add(None, t.filter("i >= j" if lower else "i <= j"), b, 1.0, eps)


def inverse(tiles: DataFrame, part: DataFrame, count: int, eps: float = 1e-8) -> DataFrame:
    """The inverse by both triangular solves of the identity."""
    low, up = lu(tiles, count, eps)
    return triangular_solve(up, triangular_solve(low, identity(part), count, True, eps), count, False, eps)


def as_tiles(x: DataFrame, part: DataFrame) -> DataFrame:
    """A vector x(idx, v) as one column of tiles."""
    dealt = x.join(part, "idx")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros((int(f["size"].iloc[0]), 1))
        t[f["pos"].to_numpy(), 0] = f["v"].to_numpy()
        return pd.DataFrame([_row(int(key[0]), -1, t)], columns=_NAMES)

    return dealt.select("tile", "pos", "size", "v").groupBy("tile").applyInPandas(run, TILES)


def as_vector(tiles: DataFrame, part: DataFrame) -> DataFrame:
    """(idx, v) of a column of tiles."""

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                yield pd.DataFrame({"tile": r.i, "pos": np.arange(r.m), "v": full(_read(r.kind, r.m, r.n, r.rank, r.a, r.b))[:, 0]})

    return tiles.mapInPandas(run, "tile long, pos int, v double").join(part, ["tile", "pos"]).select("idx", "v")


def solve(factors: tuple[DataFrame, DataFrame], x: DataFrame, part: DataFrame, count: int) -> DataFrame:
    """(idx, v) that solves L U y = x."""
    low, up = factors
    return as_vector(triangular_solve(up, triangular_solve(low, as_tiles(x, part), count, True), count, False), part)


def merged(tiles: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Tiles of two neighbouring clusters in each direction as one; tiles must be there in full or be 0."""
    dims = tiles.select(F.col("i").alias("tile"), F.col("m").alias("size")).unionByName(tiles.select(F.col("j").alias("tile"), F.col("n").alias("size"))).distinct()
    pair = dims.groupBy(F.floor(F.col("tile") / 2).cast("long").alias("p")).agg(F.max(F.when(F.col("tile") % 2 == 0, F.col("size"))).alias("first"), F.sum("size").cast("int").alias("both"))
    named = lambda s: pair.select(F.col("p").alias(f"p{s}"), F.col("first").alias(f"first_{s}"), F.col("both").alias(f"both_{s}"))
    dealt = tiles.withColumn("pi", F.floor(F.col("i") / 2).cast("long")).withColumn("pj", F.floor(F.col("j") / 2).cast("long")).join(named("i"), "pi").join(named("j"), "pj")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((int(f["both_i"].iloc[0]), int(f["both_j"].iloc[0])))
        for r in f.itertuples(index=False):
            p, q = (r.i % 2) * int(r.first_i or 0), (r.j % 2) * int(r.first_j or 0)
            out[p : p + r.m, q : q + r.n] = full(_read(r.kind, r.m, r.n, r.rank, r.a, r.b))
        return pd.DataFrame([_row(*map(int, key), out, eps)], columns=_NAMES)

    return dealt.groupBy("pi", "pj").applyInPandas(run, TILES)


def split(tiles: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Each tile as two by two: its cluster's first half (the larger one, if odd) and the rest."""

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                t = _read(r.kind, r.m, r.n, r.rank, r.a, r.b)
                p, q = (r.m + 1) // 2, (r.n + 1) // 2
                for di, rows in enumerate((slice(0, p), slice(p, r.m))):
                    for dj, cols in enumerate((slice(0, q), slice(q, r.n))):
                        if rows.stop > rows.start and cols.stop > cols.start:
                            out.append(_row(2 * r.i + di, 2 * r.j + dj, (t[0][rows], t[1][cols]) if isinstance(t, tuple) else t[rows, cols], eps))
            yield pd.DataFrame(out, columns=_NAMES)

    return tiles.mapInPandas(run, TILES)


def norm(tiles: DataFrame) -> DataFrame:
    """One row: the Frobenius norm, without forming low-rank tiles."""

    def run(frames):
        for f in frames:
            sums = []
            for r in f.itertuples(index=False):
                t = _read(r.kind, r.m, r.n, r.rank, r.a, r.b)
                sums.append(float(((t[0].T @ t[0]) * (t[1].T @ t[1])).sum()) if isinstance(t, tuple) else float((t * t).sum()))
            yield pd.DataFrame({"s": sums})

    return tiles.mapInPandas(run, "s double").agg(F.sqrt(F.greatest(F.coalesce(F.sum("s"), F.lit(0.0)), F.lit(0.0))).alias("norm"))


def leaf_histogram(tiles: DataFrame) -> DataFrame:
    """(kind, rank, tiles, bytes)."""
    return tiles.groupBy("kind", "rank").agg(F.count(F.lit(1)).alias("tiles"), F.sum(F.length("a") + F.length("b")).alias("bytes"))


def lanczos_truncation(apply: Callable, apply_t: Callable, n_rows: int, n_cols: int, eps: float, most: int = 200, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Factors of a block given by its products: Golub-Kahan steps with full orthogonalization, until the new direction adds less than eps."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal(n_cols)
    us, vs = np.zeros((n_rows, 0)), (v / np.linalg.norm(v))[:, None]
    first = 0.0
    for _ in range(min(most, n_rows, n_cols)):
        u = apply(vs[:, -1])
        u = u - us @ (us.T @ u)
        u = u - us @ (us.T @ u)
        size = np.linalg.norm(u)
        first = first or size
        if size <= 1e-3 * eps * first:
            break
        us = np.column_stack([us, u / size])
        w = apply_t(us[:, -1])
        w = w - vs @ (vs.T @ w)
        w = w - vs @ (vs.T @ w)
        size = np.linalg.norm(w)
        if size <= 1e-3 * eps * first:
            break
        vs = np.column_stack([vs, w / size])
    return truncate(us, np.column_stack([apply_t(c) for c in us.T]), eps) if us.shape[1] else (us, np.zeros((n_cols, 0)))
