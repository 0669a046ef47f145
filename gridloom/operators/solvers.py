"""Krylov solvers and eigensolvers over distributed sparse matrices.

A matrix stays a coordinate table, cut into row blocks once; a product with a
vector is one narrow pass over the blocks with the vector broadcast, and gives
back one number for each row. Vectors live on the driver, so the number of
unknowns is checked against MAX_UNKNOWNS (160 MB a vector); sparse products of
larger vectors are linalg.spmv. Matrices of up to LOCAL_ENTRIES entries are
applied on the driver, where a job would cost more than the product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_UNKNOWNS = 20_000_000
LOCAL_ENTRIES = 2_000_000
#: Fixed number of steps of the spectral norm's power iteration.
NORM_STEPS = 20

Apply = Callable[[np.ndarray], np.ndarray]


def _whole_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of entries in the order of their rows, cut anew so that none ends within a row."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f])
        last = f["row"].to_numpy() == f["row"].iloc[-1] if len(f) else np.zeros(0, bool)
        rest = f[last]
        if not last.all():
            yield f[~last]
    if rest is not None and len(rest):
        yield rest


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of whole rows of entries, each as one row: its distinct rows and columns, their places in the entries, and the values."""
    for f in _whole_rows(frames):
        each = {"val": [f["val"].to_numpy(float).tobytes()]}
        for c in ("row", "col"):
            at, where = np.unique(f[c].to_numpy(np.int64), return_inverse=True)
            each |= {c: [at.tobytes()], f"{c}_at": [where.astype(np.int32).tobytes()]}
        yield pd.DataFrame(each)[["row", "row_at", "col", "col_at", "val"]]


class SparseMap:
    """y = A x for a coordinate table of n_rows by n_cols."""

    def __init__(self, a: DataFrame, n_rows: int, n_cols: int | None = None, local_entries: int = LOCAL_ENTRIES):
        self.shape = (n_rows, n_cols or n_rows)
        if max(self.shape) > MAX_UNKNOWNS:
            raise ValueError(f"{max(self.shape)} unknowns; vectors of over {MAX_UNKNOWNS} don't fit the driver, use linalg.spmv")
        table = a.select("row", "col", F.col("val").cast("double").alias("val"))
        # Computed once, and none of a large table's entries are brought to the driver to see that they are too many.
        table = table.persist(StorageLevel.DISK_ONLY)
        self.local = table.count() <= local_entries
        if self.local:
            head = table.toPandas()
            self.row, self.col, self.val = (head[c].to_numpy() for c in ("row", "col", "val"))
        else:
            # Packed once, a batch of nearby rows to a row, so that a product neither sorts nor reads entries one by one.
            dealt = table.repartition(F.floor(F.col("row") / 4096)).sortWithinPartitions("row", "col")
            self.table = cut_lineage(dealt.mapInPandas(_packed, "row binary, row_at binary, col binary, col_at binary, val binary"))
        table.unpersist()

    def __call__(self, x: np.ndarray, transposed: bool = False) -> np.ndarray:
        n = self.shape[1] if transposed else self.shape[0]
        if self.local:
            i, j = (self.col, self.row) if transposed else (self.row, self.col)
            return np.bincount(i, self.val * x[j], n)
        i, j = ("col", "row") if transposed else ("row", "col")

        def times(r: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at, over = np.frombuffer(r[i], np.int64), np.frombuffer(r[j], np.int64)
            where, other = np.frombuffer(r[i + "_at"], np.int32), np.frombuffer(r[j + "_at"], np.int32)
            return at, np.bincount(where, np.frombuffer(r["val"]) * x[over][other], len(at))

        return self._summed(times, x, n)

    def gram(self, x: np.ndarray) -> np.ndarray:
        """A^T A x in one pass: a batch has whole rows, so it knows its part of A x."""
        if self.local:
            return self.transposed(self(x))

        def times(r: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows, cols, val = np.frombuffer(r["row_at"], np.int32), np.frombuffer(r["col_at"], np.int32), np.frombuffer(r["val"])
            at = np.frombuffer(r["col"], np.int64)
            y = np.bincount(rows, val * x[at][cols])
            return at, np.bincount(cols, val * y[rows], len(at))

        return self._summed(times, x, self.shape[1])

    def _summed(self, times: Callable[[dict, np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, n: int) -> np.ndarray:
        """The sum of what times(batch, x) gives as places and values; a task adds up its batches first, as far as they have the same places."""
        sc = self.table.sparkSession.sparkContext
        shared = sc.broadcast(np.asarray(x, float))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                done = [times(r, shared.value) for r in b.to_dict("records")]
                if done:
                    at, where = np.unique(np.concatenate([d[0] for d in done]), return_inverse=True)
                    yield pd.DataFrame({"idx": at, "v": np.bincount(where, np.concatenate([d[1] for d in done]), len(at))})

        found = self.table.mapInPandas(part, "idx long, v double").groupBy("idx").agg(F.sum("v").alias("v")).toPandas()
        shared.unpersist()
        y = np.zeros(n)
        y[found["idx"].to_numpy()] = found["v"].to_numpy()
        return y

    def transposed(self, x: np.ndarray) -> np.ndarray:
        return self(x, True)

    def diagonal(self) -> np.ndarray:
        out = np.zeros(min(self.shape))
        if self.local:
            at = self.row == self.col
            np.add.at(out, self.row[at], self.val[at])
        else:

            def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for r in b.to_dict("records"):
                        row, col = (np.frombuffer(r[c], np.int64)[np.frombuffer(r[c + "_at"], np.int32)] for c in ("row", "col"))
                        yield pd.DataFrame({"idx": row[row == col], "v": np.frombuffer(r["val"])[row == col]})

            found = self.table.mapInPandas(part, "idx long, v double").toPandas()
            np.add.at(out, found["idx"].to_numpy(int), found["v"].to_numpy(float))
        return out


class BlockMap(SparseMap):
    """y = A x for a square matrix of n unknowns in a table of blocks, as normal.product gives it."""

    def __init__(self, blocks: DataFrame, n: int, local_entries: int = LOCAL_ENTRIES):
        from .normal import BLOCK, places

        self.shape, self.table, self.block = (n, n), blocks, BLOCK
        if n > MAX_UNKNOWNS:
            raise ValueError(f"{n} unknowns; vectors of over {MAX_UNKNOWNS} don't fit the driver, use krylov")
        self.local = (blocks.agg(F.sum(F.length("val"))).first()[0] or 0) <= 8 * local_entries
        if self.local:
            each = [(r.i * BLOCK + p.astype(np.int64), r.j * BLOCK + q.astype(np.int64), val) for r in blocks.collect() for p, q, val in [places(r)]]
            self.row, self.col, self.val = (np.concatenate(x) for x in zip(*each, strict=True)) if each else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def __call__(self, x: np.ndarray, transposed: bool = False) -> np.ndarray:
        if self.local:
            return super().__call__(x, transposed)
        block, n = self.block, self.shape[0]
        i, j = ("j", "i") if transposed else ("i", "j")
        row, col = ("col", "row") if transposed else ("row", "col")

        def times(r: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.arange(r[i] * block, min(n, (r[i] + 1) * block))
            over = x[r[j] * block : (r[j] + 1) * block]
            return at, np.bincount(np.frombuffer(r[row], np.uint16), np.frombuffer(r["val"]) * over[np.frombuffer(r[col], np.uint16)], len(at))

        return self._summed(times, x, n)

    def gram(self, x: np.ndarray) -> np.ndarray:
        return self.transposed(self(x))

    def diagonal(self) -> np.ndarray:
        if self.local:
            return super().diagonal()
        out = np.zeros(self.shape[0])

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    row, col = np.frombuffer(r.row, np.uint16), np.frombuffer(r.col, np.uint16)
                    yield pd.DataFrame({"idx": r.i * block + row[row == col].astype(np.int64), "v": np.frombuffer(r.val)[row == col]})

        block = self.block
        found = self.table.filter("i = j").mapInPandas(part, "idx long, v double").toPandas()
        out[found["idx"].to_numpy(int)] = found["v"].to_numpy(float)
        return out


def _same(x: np.ndarray) -> np.ndarray:
    return x


def cg(a: Apply, b: np.ndarray, tol: float = 1e-10, most: int = 1000, prec: Apply = _same) -> tuple[np.ndarray, int]:
    """Conjugate gradients for a symmetric positive definite map, preconditioned if asked; the solution and its steps."""
    x, r = np.zeros_like(b), b.copy()
    z = prec(r)
    p, rz = z.copy(), r @ z
    stop = tol * np.linalg.norm(b)
    for step in range(most):
        if np.linalg.norm(r) <= stop:
            return x, step
        ap = a(p)
        alpha = rz / (p @ ap)
        x += alpha * p
        r -= alpha * ap
        z = prec(r)
        rz, old = r @ z, rz
        p = z + (rz / old) * p
    return x, most


def energy(a: Apply, b: np.ndarray, x: np.ndarray) -> float:
    """The functional that conjugate gradients minimise."""
    return 0.5 * x @ a(x) - b @ x


def bicg(a: Apply, at: Apply, b: np.ndarray, tol: float = 1e-10, most: int = 1000) -> tuple[np.ndarray, int]:
    x, r = np.zeros_like(b), b.copy()
    s = r.copy()
    p, q, rho = r.copy(), s.copy(), s @ r
    for step in range(most):
        if np.linalg.norm(r) <= tol * np.linalg.norm(b):
            return x, step
        ap = a(p)
        alpha = rho / (q @ ap)
        x += alpha * p
        r -= alpha * ap
        s -= alpha * at(q)
        rho, old = s @ r, rho
        p, q = r + rho / old * p, s + rho / old * q
    return x, most


def bicgstab(a: Apply, b: np.ndarray, tol: float = 1e-10, most: int = 1000, prec: Apply = _same) -> tuple[np.ndarray, int]:
    """Right-preconditioned; a right-hand side of zero gives zero; a shadow residual that has become orthogonal is renewed."""
    x = np.zeros_like(b)
    size = np.linalg.norm(b)
    if size == 0:
        return x, 0
    r = b.copy()
    shadow, p, v = r.copy(), np.zeros_like(b), np.zeros_like(b)
    rho = alpha = omega = 1.0
    for step in range(most):
        if np.linalg.norm(r) <= tol * size:
            return x, step
        rho, old = shadow @ r, rho
        if abs(rho) < 1e-32 * (shadow @ shadow):
            shadow, p, v = r.copy(), np.zeros_like(b), np.zeros_like(b)
            old = alpha = omega = 1.0
            rho = shadow @ r
        p = r + (rho / old) * (alpha / omega) * (p - omega * v)
        y = prec(p)
        v = a(y)
        alpha = rho / (shadow @ v)
        s = r - alpha * v
        z = prec(s)
        t = a(z)
        omega = (t @ s) / (t @ t) if t.any() else 0.0
        x += alpha * y + omega * z
        r = s - omega * t
    return x, most


def gmres(a: Apply, b: np.ndarray, tol: float = 1e-10, restart: int = 40, most: int = 25, prec: Apply = _same) -> tuple[np.ndarray, int]:
    """Left-preconditioned, restarted; the small least-squares problem by Givens rotations."""
    x, steps = np.zeros_like(b), 0
    goal = tol * np.linalg.norm(prec(b))
    for _ in range(most):
        r = prec(b - a(x))
        beta = np.linalg.norm(r)
        if beta <= goal:
            break
        q = [r / beta]
        h = np.zeros((restart + 1, restart))
        g = np.zeros(restart + 1)
        g[0] = beta
        turns: list[tuple[float, float]] = []
        k = 0
        for k in range(restart):
            w = prec(a(q[k]))
            for i in range(k + 1):
                h[i, k] = q[i] @ w
                w = w - h[i, k] * q[i]
            h[k + 1, k] = np.linalg.norm(w)
            if h[k + 1, k] > 1e-300:
                q.append(w / h[k + 1, k])
            for i, (c, s) in enumerate(turns):
                h[i, k], h[i + 1, k] = c * h[i, k] + s * h[i + 1, k], c * h[i + 1, k] - s * h[i, k]
            size = np.hypot(h[k, k], h[k + 1, k])
            turns.append((h[k, k] / size, h[k + 1, k] / size))
            h[k, k], h[k + 1, k] = size, 0.0
            g[k], g[k + 1] = turns[k][0] * g[k], -turns[k][1] * g[k]
            steps += 1
            if abs(g[k + 1]) <= goal or len(q) == k + 1:
                break
        x = x + np.column_stack(q[: k + 1]) @ np.linalg.solve(h[: k + 1, : k + 1], g[: k + 1])
    return x, steps


def uzawa(solve_a: Apply, b_map: Apply, bt_map: Apply, f: np.ndarray, g: np.ndarray, tol: float = 1e-10, most: int = 500) -> tuple[np.ndarray, np.ndarray, int]:
    """[A B^T; B 0] (u, p) = (f, g) by conjugate gradients on the Schur complement B A^-1 B^T."""
    schur = lambda p: b_map(solve_a(bt_map(p)))
    p, steps = cg(schur, b_map(solve_a(f)) - g, tol, most)
    return solve_a(f - bt_map(p)), p, steps


def spectral_norm(a: Apply, at: Apply, n: int, steps: int = NORM_STEPS, seed: int = 1, gram: Apply | None = None) -> float:
    """Square root of the largest eigenvalue of A^T A, by a fixed number of power steps from a random start; gram: A^T A, where it costs less than both."""
    x = np.random.default_rng(seed).standard_normal(n)
    value = 0.0
    for _ in range(steps):
        x /= np.linalg.norm(x)
        x = gram(x) if gram else at(a(x))
        value = np.linalg.norm(x)
    return float(np.sqrt(value))


def lanczos(a: Apply, n: int, k: int, basis: int | None = None, rule: str = "largest_alge", tol: float = 1e-10, most: int = 1000, b_inner: Apply = _same, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """k eigenpairs of a symmetric map (self-adjoint in the inner product x^T B y), thick-restarted."""
    basis = min(n, basis or max(2 * k + 10, 20))
    order = {"largest_alge": lambda v: -v, "smallest_alge": lambda v: v, "largest_magn": lambda v: -abs(v), "smallest_magn": lambda v: abs(v)}[rule]
    v = np.random.default_rng(seed).standard_normal(n)
    V = (v / np.sqrt(v @ b_inner(v)))[:, None]
    AV = np.zeros((n, 0))
    for _ in range(most):
        while AV.shape[1] < V.shape[1]:
            AV = np.column_stack([AV, a(V[:, AV.shape[1]])])
            if V.shape[1] < basis:
                w = AV[:, -1].copy()
                for _twice in range(2):
                    w -= V @ (V.T @ b_inner(w))
                size = np.sqrt(max(w @ b_inner(w), 0))
                if size > 1e-12 * max(1.0, np.linalg.norm(AV[:, -1])):
                    V = np.column_stack([V, w / size])
        T = V.T @ np.column_stack([b_inner(AV[:, i]) for i in range(AV.shape[1])])
        values, S = np.linalg.eigh((T + T.T) / 2)
        picked = np.argsort(order(values), kind="stable")
        top = picked[: min(k, len(picked))]
        X, AX = V @ S[:, top], AV @ S[:, top]
        residual = np.linalg.norm(AX - X * values[top], axis=0)
        if (residual <= tol * np.maximum(1.0, abs(values[top]))).all() or V.shape[1] < basis:
            return values[top], X
        keep = picked[: min(len(picked) - 1, k + (basis - k) // 2)]
        V, AV = V @ S[:, keep], AV @ S[:, keep]
        w = (AX - X * values[top])[:, int(residual.argmax())]
        for _twice in range(2):
            w = w - V @ (V.T @ b_inner(w))
        V = np.column_stack([V, w / np.sqrt(w @ b_inner(w))])
    return values[top], X


def inverse_by_components(a: SparseMap, sigma: float = 0.0, most: int = 20_000_000) -> Apply:
    """x -> (A - sigma I)^-1 x from dense inverses of the parts that A's entries connect; ValueError if they have more than `most` numbers."""
    if not a.local:
        raise ValueError("too many entries for the driver")
    n = a.shape[0]
    label = _connected(a.row, a.col, n)
    order = np.argsort(label, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1])))
    size = np.diff(np.append(start, n))
    if (size.astype(float) ** 2).sum() > most:
        raise ValueError("the matrix's parts are too large for dense inverses")
    place, part = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order], part[order] = np.arange(n) - np.repeat(start, size), np.repeat(np.arange(len(start)), size)
    blocks = []
    for s in np.unique(size):
        of = np.flatnonzero(size == s)
        number = np.full(len(start), -1)
        number[of] = np.arange(len(of))
        here = number[part[a.row]] >= 0
        dense = np.tile(-sigma * np.eye(s), (len(of), 1, 1))
        np.add.at(dense, (number[part[a.row[here]]], place[a.row[here]], place[a.col[here]]), a.val[here])
        blocks.append((order[start[of][:, None] + np.arange(s)], np.linalg.inv(dense)))

    def apply(x: np.ndarray) -> np.ndarray:
        y = np.empty(n)
        for at, inverse in blocks:
            y[at] = np.einsum("cij,cj->ci", inverse, x[at])
        return y

    return apply


def shift_invert(solve_shifted: Apply, sigma: float, n: int, k: int, **options) -> tuple[np.ndarray, np.ndarray]:
    """The k eigenvalues nearest to sigma, by Lanczos on (A - sigma I)^-1."""
    inverse, X = lanczos(solve_shifted, n, k, rule="largest_magn", **options)
    return sigma + 1 / inverse, X


def arnoldi(a: Apply, n: int, k: int, basis: int | None = None, rule: str = "largest_magn", tol: float = 1e-9, most: int = 300, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """k eigenpairs of a general map, by Arnoldi restarted with the wanted invariant directions."""
    basis = min(n, basis or max(2 * k + 20, 40))
    order = {"largest_magn": lambda v: -abs(v), "largest_real": lambda v: -v.real, "smallest_magn": lambda v: abs(v), "smallest_real": lambda v: v.real, "largest_imag": lambda v: -abs(v.imag), "smallest_imag": lambda v: abs(v.imag)}[rule]
    start = np.random.default_rng(seed).standard_normal((n, 1))
    values = X = None
    for _ in range(most):
        V = np.linalg.qr(start)[0]
        AV = np.zeros((n, 0))
        while AV.shape[1] < V.shape[1]:
            AV = np.column_stack([AV, a(V[:, AV.shape[1]])])
            if V.shape[1] < basis:
                w = AV[:, -1].copy()
                for _twice in range(2):
                    w -= V @ (V.T @ w)
                size = np.linalg.norm(w)
                if size > 1e-12:
                    V = np.column_stack([V, w / size])
        lam, S = np.linalg.eig(V.T @ AV)
        top = np.argsort(order(lam), kind="stable")[:k]
        values, X = lam[top], V @ S[:, top]
        residual = np.linalg.norm(AV @ S[:, top] - X * values, axis=0)
        if (residual <= tol * np.maximum(1.0, abs(values))).all() or V.shape[1] < basis:
            break
        keep = np.argsort(order(lam), kind="stable")[: k + 4]
        start = np.column_stack([np.real(V @ S[:, keep]), np.imag(V @ S[:, keep])])
        start = start[:, np.linalg.norm(start, axis=0) > 1e-14]
    return values, X


#: Unknowns of a part that is taken whole, entries that a task is dealt, and numbers of its dense parts at once.
WHOLE, DEALT, DENSE = 128, 200_000, 1 << 22


def arnoldi_by_parts(a: DataFrame, n: int, k: int, whole: int = WHOLE, **options) -> np.ndarray:
    """The k eigenvalues of greatest magnitude of a matrix of entries (row, col, val), each as often as the parts that its entries connect have it.

    A basis that starts from one vector meets an eigenvalue once, however many parts share it, and its vectors are on
    the driver. So parts of up to `whole` unknowns are projected on all of their unknowns, where they are dealt to
    tasks, and only the others together go through `arnoldi`. A task returns k values.
    """
    from .graph import components
    from .ranges import renumbered

    a = cut_lineage(a.select("row", "col", F.col("val").cast("double").alias("val")), sized=False)
    label = cut_lineage(components(a.filter("row <> col").select(F.col("row").alias("src"), F.col("col").alias("dst"))))
    large = cut_lineage(label.groupBy("component").agg(F.count(F.lit(1)).alias("_s")).filter(F.col("_s") > whole).select("component"), compact=True)
    named = a.join(label.withColumnRenamed("id", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))

    def part(f: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([f["row"], f["col"]]), return_inverse=True)
        row, col = at[: len(f)], at[len(f) :]
        _, of = np.unique(f["component"].to_numpy(), return_inverse=True)
        owner = np.empty(len(ids), np.int64)
        owner[row], owner[col] = of, of
        size = np.bincount(owner)
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        found = [np.zeros(0, complex)]
        for s in np.unique(size):
            same = np.flatnonzero(size == s)
            step = max(1, DENSE // int(s * s))
            for i in range(0, len(same), step):
                number = np.full(len(size), -1)
                number[same[i : i + step]] = np.arange(len(same[i : i + step]))
                here = number[of] >= 0
                dense = np.zeros((len(same[i : i + step]), s, s))
                np.add.at(dense, (number[of[here]], place[row[here]], place[col[here]]), f["val"].to_numpy()[here])
                found.append(np.linalg.eigvals(dense).ravel())
        v = np.concatenate(found)
        v = v[np.argsort(-abs(v), kind="stable")[:k]]
        return pd.DataFrame({"re": v.real, "im": v.imag})

    tasks = max(1, -(-a.count() // DEALT))
    small = named.join(large, "component", "left_anti").withColumn("_t", F.pmod(F.xxhash64("component"), F.lit(tasks)))
    values = small.groupBy("_t").applyInPandas(part, "re double, im double").orderBy(F.desc(F.hypot("re", "im")), "re", "im").limit(k).toPandas()
    values = (values["re"] + 1j * values["im"]).to_numpy(complex)
    rest = label.join(large, "component", "left_semi").select(F.col("id").alias("idx"), F.col("id").alias("_old"))
    if m := rest.count():
        numbers = cut_lineage(renumbered(rest))
        side = lambda c: numbers.select(F.col("_old").alias(c), F.col("idx").alias(f"_{c}"))
        moved = SparseMap(a.join(side("row"), "row").join(side("col"), "col").select(F.col("_row").alias("row"), F.col("_col").alias("col"), "val"), m)
        values = np.concatenate([values, arnoldi(moved, m, min(k, m), **options)[0]])
    # Unknowns without entries are zeros, the least of all.
    values = np.append(values, np.zeros(max(0, min(k, n) - len(values))))
    return values[np.argsort(-abs(values), kind="stable")[:k]]


def davidson(a: Apply, diagonal: np.ndarray, k: int, tol: float = 1e-9, most: int = 500, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """k largest eigenpairs of a symmetric map; corrections are residuals divided by the shifted diagonal."""
    n = len(diagonal)
    V = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, 2 * k)))[0]
    for _ in range(most):
        AV = np.column_stack([a(v) for v in V.T])
        lam, S = np.linalg.eigh(V.T @ AV)
        lam, S = lam[::-1][:k], S[:, ::-1][:, :k]
        X = V @ S
        R = AV @ S - X * lam
        bad = np.linalg.norm(R, axis=0) > tol * np.maximum(1.0, abs(lam))
        if not bad.any():
            break
        gap = diagonal[:, None] - lam[None, bad]
        gap[abs(gap) < 1e-8] = 1e-8
        if V.shape[1] + bad.sum() > min(n, 12 * k):
            V = X
        V = np.linalg.qr(np.column_stack([V, R[:, bad] / gap]))[0]
    return lam, X


def lobpcg(a: Apply, n: int, k: int, prec: Apply = _same, tol: float = 1e-8, most: int = 500, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """k smallest eigenpairs of a symmetric map by locally optimal block conjugate gradients."""
    each = lambda f, M: np.column_stack([f(c) for c in M.T])
    X = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, k)))[0]
    P = np.zeros((n, 0))
    lam = np.zeros(k)
    for _ in range(most):
        AX = each(a, X)
        lam, S = np.linalg.eigh(X.T @ AX)
        X, AX = X @ S, AX @ S
        R = AX - X * lam
        if (np.linalg.norm(R, axis=0) <= tol * np.maximum(1.0, abs(lam))).all():
            break
        Q = np.linalg.qr(np.column_stack([X, each(prec, R), P]))[0]
        lam, S = np.linalg.eigh(Q.T @ each(a, Q))
        new = Q @ S[:, :k]
        P = new - X @ (X.T @ new)
        P = P[:, np.linalg.norm(P, axis=0) > 1e-13]
        X = new
    return lam[:k], X


def partial_svd(a: Apply, at: Apply, n_rows: int, n_cols: int, k: int, **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k leading singular triplets, through A^T A or A A^T, whichever is smaller."""
    if n_cols <= n_rows:
        lam, V = lanczos(lambda x: at(a(x)), n_cols, k, **options)
        s = np.sqrt(np.maximum(lam, 0))
        return np.column_stack([a(v) for v in V.T]) / np.maximum(s, 1e-300), s, V
    lam, U = lanczos(lambda x: a(at(x)), n_rows, k, **options)
    s = np.sqrt(np.maximum(lam, 0))
    return U, s, np.column_stack([at(u) for u in U.T]) / np.maximum(s, 1e-300)


# Factorizations of dense blocks, as they occur in leaves and small projections.


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unpivoted: a unit lower and an upper triangle."""
    u, low = np.array(a, float), np.eye(len(a))
    for k in range(len(a) - 1):
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :, k:] -= np.outer(low[k + 1 :, k], u[k, k:])
        u[k + 1 :, k] = 0
    return low, u


def ldlt(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unpivoted: a unit lower triangle and a diagonal."""
    low, u = lu(a)
    return low, np.diag(u).copy()


def triangular(t: np.ndarray, b: np.ndarray, lower: bool = True, transposed: bool = False, unit: bool = False) -> np.ndarray:
    """Solve T x = b or T^T x = b by substitution."""
    t = t.T if transposed else t
    lower ^= transposed
    x = np.array(b, float)
    rows = range(len(t)) if lower else range(len(t) - 1, -1, -1)
    for i in rows:
        j = slice(0, i) if lower else slice(i + 1, None)
        x[i] = (x[i] - t[i, j] @ x[j]) / (1.0 if unit else t[i, i])
    return x


def ilut(a: DataFrame, n: int, drop: float = 1e-3, fill: int = 20) -> Apply:
    """An incomplete LU preconditioner with a threshold, for matrices that fit the driver (LOCAL_ENTRIES)."""
    entries = a.select("row", "col", "val").limit(LOCAL_ENTRIES + 1).toPandas()
    if len(entries) > LOCAL_ENTRIES:
        raise ValueError("too many entries for the driver")
    rows: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, v in entries.itertuples(index=False):
        rows[i][j] = rows[i].get(j, 0.0) + v
    low: list[dict[int, float]] = []
    up: list[dict[int, float]] = []
    for i, row in enumerate(rows):
        w, size = dict(row), np.sqrt(sum(v * v for v in row.values()))
        done: set[int] = set()
        while left := [k for k in w if k < i and k not in done]:
            k = min(left)
            done.add(k)
            w[k] /= up[k][k]
            if abs(w[k]) < drop * size:
                del w[k]
                continue
            for j, v in up[k].items():
                if j > k:
                    w[j] = w.get(j, 0.0) - w[k] * v
        kept = lambda part: dict(sorted(part, key=lambda x: -abs(x[1]))[:fill])
        low.append(kept([(j, v) for j, v in w.items() if j < i and abs(v) >= drop * size]))
        up.append({i: w.get(i) or size or 1.0} | kept([(j, v) for j, v in w.items() if j > i and abs(v) >= drop * size]))

    def apply(r: np.ndarray) -> np.ndarray:
        x = np.array(r, float)
        for i in range(n):
            x[i] -= sum(v * x[j] for j, v in low[i].items())
        for i in range(n - 1, -1, -1):
            x[i] = (x[i] - sum(v * x[j] for j, v in up[i].items() if j != i)) / up[i][i]
        return x

    return apply


def block_preconditioner(solve_a: Apply, solve_s: Apply, d_map: Apply, n_u: int, coupled: bool = True) -> Apply:
    """r1 <- A^-1 r1, then r2 <- S^-1 (r2 - D r1) with the solved r1 (triangular), or S^-1 r2 alone (diagonal)."""

    def apply(r: np.ndarray) -> np.ndarray:
        first = solve_a(r[:n_u])
        return np.concatenate([first, solve_s(r[n_u:] - d_map(first) if coupled else r[n_u:])])

    return apply


def schur_map(c: Apply, d_map: Apply, g_map: Apply, solve_a: Apply) -> Apply:
    """x -> C x - D A^-1 G x."""
    return lambda x: c(x) - d_map(solve_a(g_map(x)))


def preconditioner_quality(a: Apply, at: Apply, prec: Apply, prec_t: Apply, n: int, steps: int = NORM_STEPS) -> float:
    """The spectral norm of I - P^-1 A."""
    return spectral_norm(lambda x: x - prec(a(x)), lambda x: x - at(prec_t(x)), n, steps)


def condition_estimate(a: np.ndarray) -> float:
    """Maximum-norm condition number of a matrix that fits the driver."""
    return float(np.linalg.cond(a, np.inf))


def _connected(row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    """The least index of each index's part, where entries connect them."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, label[row], label[col])
        np.minimum.at(new, label[col], label[row])
        new = new[new][label]
        if (new == label).all():
            return label
        label = new


#: Numbers of dense parts that are inverted at once.
INVERTED = 2_000_000


def condition_by_parts(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> float:
    """Maximum-norm condition number of a matrix of entries: only the parts that they connect are dense, some at a time."""
    label = _connected(row, col, n)
    order = np.argsort(label, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(label[order]) != 0))
    size = np.diff(np.append(start, n))
    place, part = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order], part[order] = np.arange(n) - np.repeat(start, size), np.repeat(np.arange(len(start)), size)
    by_part = np.argsort(part[row], kind="stable")
    ends = np.searchsorted(part[row][by_part], np.arange(len(start) + 1))
    norm = inverse = 0.0
    for s in np.unique(size):
        of, step = np.flatnonzero(size == s), max(1, INVERTED // int(s) ** 2)
        for some in (of[i : i + step] for i in range(0, len(of), step)):
            count = ends[some + 1] - ends[some]
            at = by_part[np.arange(count.sum()) + np.repeat(ends[some] - (np.cumsum(count) - count), count)]
            dense = np.zeros((len(some), s, s))
            np.add.at(dense, (np.repeat(np.arange(len(some)), count), place[row[at]], place[col[at]]), val[at])
            norm = max(norm, np.abs(dense).sum(axis=2).max())
            try:
                inverse = max(inverse, np.abs(np.linalg.inv(dense)).sum(axis=2).max())
            except np.linalg.LinAlgError:
                return float("inf")
    return float(norm * inverse)


class Solver:
    """A prepared solver: solve(b) for a right side, psolve(b) as a preconditioner (one application, no tolerance asked)."""

    def __init__(self, method: Callable[..., tuple[np.ndarray, int]], a: Apply, **options):
        self.method, self.a, self.options, self.steps = method, a, options, 0

    def solve(self, b: np.ndarray) -> np.ndarray:
        x, self.steps = self.method(self.a, b, **self.options)
        return x

    def psolve(self, b: np.ndarray) -> np.ndarray:
        prec = self.options.get("prec", _same)
        return prec(b)


class Truncation:
    """Factors of a block given by products with it: by `svd` of its factors, by `random` probes or by `lanczos` steps."""

    def __init__(self, method: str = "svd", eps: float = 1e-8):
        self.method, self.eps = method, eps

    def __call__(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from .harith import lanczos_truncation
        from .lowrank import randomized, truncate

        if self.method == "svd":
            return truncate(a, b, self.eps)
        apply, apply_t = (lambda x: a @ (b.T @ x)), (lambda x: b @ (a.T @ x))
        if self.method == "random":
            return randomized(apply, apply_t, len(b), self.eps)
        return lanczos_truncation(apply, apply_t, len(a), len(b), self.eps)

    def trace(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, float]]:
        """(rank, spectral norm of the error) for each rank up to the one kept."""
        u, v = self(a, b)
        qu, ru = np.linalg.qr(u)
        qv, rv = np.linalg.qr(v)
        x, s, yt = np.linalg.svd(ru @ rv.T)
        whole = a @ b.T
        return [(k, float(np.linalg.norm(whole - (qu @ x[:, :k] * s[:k]) @ (yt[:k] @ qv.T), 2))) for k in range(len(s) + 1)]


def orthogonalized(v: np.ndarray, method: str = "modified") -> np.ndarray:
    """Orthonormal columns with the span of v's: classical, modified, twice (classical, repeated), householder or cholesky."""
    v = np.array(v, float)
    if method == "householder":
        return np.linalg.qr(v)[0]
    if method == "cholesky":
        return np.linalg.solve(np.linalg.cholesky(v.T @ v), v.T).T
    q = np.zeros((len(v), 0))
    for x in v.T:
        for _ in range(2 if method == "twice" else 1):
            if method == "modified":
                for w in q.T:
                    x = x - w * (w @ x)
            else:
                x = x - q @ (q.T @ x)
        size = np.linalg.norm(x)
        if size == 0:
            raise ZeroDivisionError("the columns are dependent")
        q = np.column_stack([q, x / size])
    return q


def tridiagonal_eigen(diagonal: np.ndarray, beside: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of a symmetric tridiagonal matrix: QR steps with Wilkinson's shift, by rotations."""
    n = len(diagonal)
    t = np.diag(np.array(diagonal, float)) + np.diag(np.array(beside, float), 1) + np.diag(np.array(beside, float), -1)
    q, hi, spent = np.eye(n), n - 1, 0
    while hi > 0:
        if abs(t[hi, hi - 1]) <= 1e-15 * (abs(t[hi, hi]) + abs(t[hi - 1, hi - 1])):
            t[hi, hi - 1] = t[hi - 1, hi] = 0
            hi, spent = hi - 1, 0
            continue
        spent += 1
        if spent > most:
            raise RuntimeError("the eigenvalues didn't settle")
        d = (t[hi - 1, hi - 1] - t[hi, hi]) / 2
        e2 = t[hi, hi - 1] ** 2
        shift = t[hi, hi] - e2 / (d + (np.sqrt(d * d + e2) if d >= 0 else -np.sqrt(d * d + e2))) if d or e2 else t[hi, hi]
        m = hi + 1
        qk, rk = hessenberg_qr(t[:m, :m] - shift * np.eye(m))
        t[:m, :m] = rk @ qk + shift * np.eye(m)
        q[:, :m] = q[:, :m] @ qk
    order = np.argsort(np.diag(t), kind="stable")
    return np.diag(t)[order], q[:, order]


def hessenberg_qr(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and R of an upper Hessenberg matrix, by one rotation for each entry below the diagonal."""
    r, q = np.array(h, float), np.eye(len(h))
    for k in range(len(h) - 1):
        size = np.hypot(r[k, k], r[k + 1, k])
        if size == 0:
            continue
        g = np.array([[r[k, k], r[k + 1, k]], [-r[k + 1, k], r[k, k]]]) / size
        r[k : k + 2] = g @ r[k : k + 2]
        q[:, k : k + 2] = q[:, k : k + 2] @ g.T
    return q, np.triu(r)


def bunch_kaufman(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, L, D with P A P^T = L D L^T of a symmetric matrix that need not be definite; D has blocks of one or two."""
    a, n = np.array(a, float), len(a)
    p, low, d = np.arange(n), np.eye(n), np.zeros((n, n))
    alpha, k = (1 + 17**0.5) / 8, 0

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]
        low[[i, j], :k] = low[[j, i], :k]
        p[[i, j]] = p[[j, i]]

    while k < n:
        size = 1
        if k + 1 < n:
            r = k + 1 + int(np.abs(a[k + 1 :, k]).argmax())
            lam = abs(a[r, k])
            if lam > 0 and abs(a[k, k]) < alpha * lam:
                others = np.abs(a[k:, r]).copy()
                others[r - k] = 0
                sigma = others.max()
                if abs(a[k, k]) * sigma >= alpha * lam * lam:
                    pass
                elif abs(a[r, r]) >= alpha * sigma:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        block = a[k : k + size, k : k + size].copy()
        d[k : k + size, k : k + size] = block
        if k + size < n and np.abs(block).max() > 0:
            c = a[k + size :, k : k + size]
            m = np.linalg.solve(block, c.T).T
            low[k + size :, k : k + size] = m
            a[k + size :, k + size :] -= m @ c.T
        k += size
    return p, low, d
