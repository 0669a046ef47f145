"""H2-matrices with stored bases: orthogonalization, compression to an accuracy, rank-one updates, and products.

A leaf cluster t has its basis V_t, any other the basis made of its sons' by transfer
matrices: V_t = [V_1 E_1; V_2 E_2]. Rows and columns share one basis. Admissible blocks
are V_r S V_c^T with couplings S, the others are stored densely between leaves.

Everything goes level by level: the sons' (or the couplings') matrices of a cluster meet
in one grouped pass, whose groups are two sons or the bounded number of blocks a
cluster has. A task never holds more than the small matrices of one cluster.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .h2 import Kernel, _boxed, _summed, _vectors, grid_points, interpolation, leaf_blocks


class H2(NamedTuple):
    leaves: DataFrame  # node, ids array<long>, k int, v binary: len(ids) by k
    transfers: DataFrame  # node, k int, kf int, e binary: k by the father's kf
    couplings: DataFrame  # r, c, kr int, kc int, s binary
    near: DataFrame  # r, c, rows array<long>, cols array<long>, a binary
    depth: int


_LEAVES = "node long, ids array<long>, k int, v binary"
_TRANSFERS = "node long, k int, kf int, e binary"
_COUPLINGS = "r long, c long, kr int, kc int, s binary"
_NEAR = "r long, c long, rows array<long>, cols array<long>, a binary"
_CHANGES = "node long, m int, k int, x binary"


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _of(x: bytes, m: int, k: int) -> np.ndarray:
    return np.frombuffer(x).reshape(m, k)


def _rows(frames, work, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]
    for f in frames:
        yield pd.DataFrame([work(r) for r in f.itertuples(index=False)], columns=names)


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    return df.mapInPandas(lambda frames: _rows(frames, work, schema), schema)


def from_kernel(points: DataFrame, nodes: DataFrame, axes: list[str], blocks: DataFrame, kernel: Kernel, m: int) -> H2:
    """A kernel interpolated at m points an axis; points(id, node, x) with leaf numbers, blocks: leaves of the block tree."""
    own, fathers = _boxed(nodes, axes), _boxed(nodes, axes, "f_")
    listed = points.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("p"))
    ids = F.transform("p", lambda e: e["id"]).alias("ids")
    xs = F.transform("p", lambda e: e["x"]).alias("xs")

    def leaf(r):
        v = interpolation(m, np.asarray(r.lo), np.asarray(r.hi), _vectors(r.xs))
        return r.node, r.ids, v.shape[1], _bytes(v)

    def transfer(r):
        e = interpolation(m, np.asarray(r.f_lo), np.asarray(r.f_hi), grid_points(m, np.asarray(r.lo), np.asarray(r.hi)))
        return r.node, *e.shape, _bytes(e)

    def coupling(r):
        s = kernel(grid_points(m, np.asarray(r.r_lo), np.asarray(r.r_hi)), grid_points(m, np.asarray(r.c_lo), np.asarray(r.c_hi)))
        return r.r_node, r.c_node, *s.shape, _bytes(s)

    def close(r):
        return r.r_node, r.c_node, r.rows, r.cols, _bytes(kernel(_vectors(r.xs), _vectors(r.ys)))

    sons = nodes.filter("node > 1").select("node", F.shiftright("node", 1).alias("f_node"))
    found = blocks.filter("leaf")
    far = found.filter("admissible").select("r_node", "c_node").join(_boxed(nodes, axes, "r_"), "r_node").join(_boxed(nodes, axes, "c_"), "c_node")
    pairs = leaf_blocks(nodes, found.filter("NOT admissible").select("r_node", "c_node"))
    both = pairs.join(listed.select(F.col("node").alias("r_node"), ids.alias("rows"), xs), "r_node").join(listed.select(F.col("node").alias("c_node"), ids.alias("cols"), xs.alias("ys")), "c_node")
    return H2(
        cut_lineage(_mapped(listed.select("node", ids, xs).join(own, "node"), leaf, _LEAVES)),
        cut_lineage(_mapped(sons.join(own, "node").join(fathers, "f_node"), transfer, _TRANSFERS)),
        cut_lineage(_mapped(far, coupling, _COUPLINGS)),
        cut_lineage(_mapped(both, close, _NEAR)),
        int(nodes.agg(F.max("level")).first()[0]),
    )


def _changed(h: H2, couplings: DataFrame, changes: DataFrame) -> DataFrame:
    """Couplings C_r S C_c^T after a change of basis V = V' C; changes(node, m, k, x) has C, m by k."""
    side = lambda s: changes.select(F.col("node").alias(s), F.col("m").alias(f"m_{s}"), F.col("x").alias(f"x_{s}"))

    def run(r):
        s = _of(r.x_r, r.m_r, r.kr) @ _of(r.s, r.kr, r.kc) @ _of(r.x_c, r.m_c, r.kc).T
        return r.r, r.c, *s.shape, _bytes(s)

    return _mapped(couplings.join(side("r"), "r").join(side("c"), "c"), run, _COUPLINGS)


def _level(name: str = "node"):
    return F.length(F.bin(name)) - 1


def _upward(h: H2, leaf_work, father_work, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New leaves, transfers and changes of basis, from the leaves up.

    leaf_work(V, Z) gives V' and C with V ~ V' C; father_work(W, Z) gives Q and C with W ~ Q C, for the
    stacked W = [C_1 E_1; C_2 E_2] of a cluster's sons. extra(node, zm, z): a matrix Z of each cluster, zm by k.
    """
    with_z = lambda df: df.withColumn("zm", F.lit(0)).withColumn("z", F.lit(b"")) if extra is None else df.join(extra, "node")

    def leaf(r):
        v, c = leaf_work(_of(r.v, len(r.ids), r.k), _of(r.z, r.zm, r.k) if r.zm else None)
        return r.node, r.ids, v.shape[1], _bytes(v), *c.shape, _bytes(c)

    done = cut_lineage(_mapped(with_z(h.leaves), leaf, "node long, ids array<long>, k int, v binary, m int, kc int, x binary"))
    leaves = done.select("node", "ids", "k", "v")
    changes = done.select("node", "m", F.col("kc").alias("k"), "x")
    transfers = None

    def father(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        parts = [_of(r.x, r.m, r.k) @ _of(r.e, r.k, r.kf) for r in f.itertuples(index=False)]
        first = f.iloc[0]
        q, c = father_work(np.concatenate(parts), _of(first["z"], int(first["zm"]), parts[0].shape[1]) if first["zm"] else None)
        out, at = [(int(key[0]), "change", *c.shape, _bytes(c))], 0
        for r, p in zip(f.itertuples(index=False), parts, strict=True):
            out.append((r.node, "transfer", len(p), q.shape[1], _bytes(q[at : at + len(p)])))
            at += len(p)
        return pd.DataFrame(out, columns=["node", "what", "m", "k", "x"])

    for level in range(h.depth, 0, -1):
        sons = changes.filter(_level() == level).join(h.transfers.select("node", "kf", "e"), "node").withColumn("father", F.shiftright("node", 1))
        named = sons.select("father", F.struct("node", "m", "k", "x", "kf", "e").alias("son"))
        z = with_z(named.select(F.col("father").alias("node")).distinct()).select(F.col("node").alias("father"), "zm", "z")
        up = cut_lineage(named.join(z, "father").select("father", "son.*", "zm", "z").groupBy("father").applyInPandas(father, "node long, what string, m int, k int, x binary"))
        changes = changes.unionByName(up.filter("what = 'change'").drop("what"))
        mine = up.filter("what = 'transfer'").select("node", F.col("m").alias("k"), F.col("k").alias("kf"), F.col("x").alias("e"))
        transfers = mine if transfers is None else transfers.unionByName(mine)
    return leaves, transfers if transfers is not None else h.transfers, changes


def orthogonalized(h: H2) -> H2:
    """The same matrix with orthonormal bases: QR of leaves and of stacked transfers, and couplings that take up the triangles."""

    def qr(w, _):
        return np.linalg.qr(w)

    leaves, transfers, changes = _upward(h, qr, qr)
    return H2(leaves, transfers, cut_lineage(_changed(h, h.couplings, changes)), h.near, h.depth)


def weights(h: H2) -> DataFrame:
    """(node, zm, z): for orthonormal bases, triangles Z_t whose Z_t^T Z_t is that of all couplings that use the basis of t, its own and its ancestors'."""
    own = h.couplings.select(F.col("r").alias("node"), F.col("kc").alias("m"), F.col("kr").alias("k"), "s", F.lit(True).alias("turn")).unionByName(h.couplings.select(F.col("c").alias("node"), F.col("kr").alias("m"), F.col("kc").alias("k"), "s", F.lit(False).alias("turn")))

    def total(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        parts = [_of(r.s, r.k, r.m).T if r.turn else _of(r.s, r.m, r.k) for r in f.itertuples(index=False)]
        z = np.linalg.qr(np.concatenate(parts), mode="r")
        z = z if len(z) else np.zeros((1, z.shape[1]))  # nothing uses this basis
        return pd.DataFrame([(int(key[0]), len(z), z.shape[1], _bytes(z))], columns=["node", "zm", "k", "z"])

    def inherit(r):
        z = _of(r.z, r.zm, r.kf) @ _of(r.e, r.k, r.kf).T
        return r.node, r.zm, r.k, _bytes(z), False

    # Every cluster has a row: an empty matrix where no block uses it.
    ranks = h.transfers.select("node", "k").unionByName(h.transfers.filter("node < 4").select(F.shiftright("node", 1).alias("node"), F.col("kf").alias("k")).distinct())
    if h.depth == 0:
        ranks = h.leaves.select("node", "k")
    nothing = ranks.select("node", F.lit(0).alias("m"), "k", F.lit(b"").alias("s"), F.lit(False).alias("turn"))
    own = own.unionByName(nothing)
    found = now = cut_lineage(own.filter(_level() == 0).groupBy("node").applyInPandas(total, "node long, zm int, k int, z binary"))
    for level in range(1, h.depth + 1):
        sons = h.transfers.filter(_level() == level).withColumn("father", F.shiftright("node", 1)).join(now.select(F.col("node").alias("father"), "zm", "z"), "father")
        from_above = _mapped(sons.select("node", "k", "kf", "e", "zm", "z"), inherit, "node long, m int, k int, s binary, turn boolean")
        now = cut_lineage(own.filter(_level() == level).unionByName(from_above).groupBy("node").applyInPandas(total, "node long, zm int, k int, z binary"))
        found = found.unionByName(now)
    return found.select("node", "zm", "z")


def compressed(h: H2, eps: float) -> H2:
    """The matrix with the smallest bases that keep, in each cluster, the singular values above eps times its first; h's bases must be orthonormal."""

    def cut(w, z):
        u, s, _ = np.linalg.svd(w if z is None else w @ z.T, full_matrices=False)
        q = u[:, : int((s > eps * s[0]).sum())] if len(s) and s[0] > 0 else u[:, :0]
        q = q if q.shape[1] else np.eye(len(w), 1)  # a basis that nothing uses keeps one vector
        return q, q.T @ w

    leaves, transfers, changes = _upward(h, cut, cut, weights(h))
    return H2(leaves, transfers, cut_lineage(_changed(h, h.couplings, changes)), h.near, h.depth)


def updated(h: H2, x: DataFrame, y: DataFrame) -> H2:
    """The matrix plus x y^T, for x, y(idx, v): each basis gets the rows of both as two more columns, each block its product; `compressed` takes back what isn't needed."""
    spread = h.leaves.select("node", F.posexplode("ids").alias("at", "idx")).join(x.select("idx", F.col("v").alias("_x")), "idx", "left").join(y.select("idx", F.col("v").alias("_y")), "idx", "left")
    both = spread.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("_x", F.lit(0.0)).alias("x"), F.coalesce("_y", F.lit(0.0)).alias("y")))), lambda e: F.array(e["x"], e["y"])).alias("xy"))

    def leaf(r):
        v = np.column_stack([_of(r.v, len(r.ids), r.k), _vectors(r.xy)])
        return r.node, r.ids, v.shape[1], _bytes(v)

    def transfer(r):
        e = np.zeros((r.k + 2, r.kf + 2))
        e[: r.k, : r.kf], e[r.k :, r.kf :] = _of(r.e, r.k, r.kf), np.eye(2)
        return r.node, *e.shape, _bytes(e)

    def coupling(r):
        s = np.zeros((r.kr + 2, r.kc + 2))
        s[: r.kr, : r.kc], s[r.kr, r.kc + 1] = _of(r.s, r.kr, r.kc), 1.0
        return r.r, r.c, *s.shape, _bytes(s)

    def close(r):
        a = _of(r.a, len(r.rows), len(r.cols)) + np.outer(_vectors(r.r_xy)[:, 0], _vectors(r.c_xy)[:, 1])
        return r.r, r.c, r.rows, r.cols, _bytes(a)

    near = h.near.join(both.select(F.col("node").alias("r"), F.col("xy").alias("r_xy")), "r").join(both.select(F.col("node").alias("c"), F.col("xy").alias("c_xy")), "c")
    return H2(
        cut_lineage(_mapped(h.leaves.join(both, "node"), leaf, _LEAVES)),
        cut_lineage(_mapped(h.transfers, transfer, _TRANSFERS)),
        cut_lineage(_mapped(h.couplings, coupling, _COUPLINGS)),
        cut_lineage(_mapped(near, close, _NEAR)),
        h.depth,
    )


def matvec(h: H2, x: DataFrame) -> DataFrame:
    """(idx, v) of the matrix times x(idx, v): coefficients up the tree, across the couplings, down the tree, and the near field."""
    spread = h.leaves.select("node", F.posexplode("ids").alias("at", "idx")).join(x, "idx", "left")
    own = cut_lineage(spread.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("v", F.lit(0.0)).alias("v")))), lambda e: e["v"]).alias("x")))
    c_of = "node long, c array<double>"
    level = _mapped(h.leaves.join(own, "node"), lambda r: (r.node, list(_of(r.v, len(r.ids), r.k).T @ np.asarray(r.x))), c_of)
    up = cut_lineage(level)
    for at in range(h.depth, 0, -1):
        raised = _mapped(up.filter(_level() == at).join(h.transfers, "node"), lambda r: (r.node >> 1, list(_of(r.e, r.k, r.kf).T @ np.asarray(r.c))), c_of)
        up = up.unionByName(cut_lineage(_summed(raised)))
    across = h.couplings.join(up.select(F.col("node").alias("c"), F.col("c").alias("x")), "c")
    now = cut_lineage(_summed(_mapped(across, lambda r: (r.r, list(_of(r.s, r.kr, r.kc) @ np.asarray(r.x))), c_of)))
    for at in range(1, h.depth + 1):
        down = h.transfers.filter(_level() == at).withColumn("father", F.shiftright("node", 1)).join(now.select(F.col("node").alias("father"), "c"), "father")
        now = cut_lineage(_summed(now.unionByName(_mapped(down, lambda r: (r.node, list(_of(r.e, r.k, r.kf) @ np.asarray(r.c))), c_of))))

    def far(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                yield pd.DataFrame({"idx": r.ids, "v": _of(r.v, len(r.ids), r.k) @ np.asarray(r.c)})

    def close(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                yield pd.DataFrame({"idx": r.rows, "v": _of(r.a, len(r.rows), len(r.cols)) @ np.asarray(r.x)})

    parts = h.leaves.join(now, "node").mapInPandas(far, "idx long, v double").unionByName(h.near.join(own.select(F.col("node").alias("c"), "x"), "c").mapInPandas(close, "idx long, v double"))
    return parts.groupBy("idx").agg(F.sum("v").alias("v"))


def ranks(h: H2) -> DataFrame:
    """(node, k): the rank of each cluster's basis."""
    root = h.transfers.filter("node < 4").select(F.shiftright("node", 1).alias("node"), F.col("kf").alias("k")).distinct()
    return (h.transfers.select("node", "k").unionByName(root)) if h.depth else h.leaves.select("node", "k")
