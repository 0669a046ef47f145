"""Scalar functions as Column expressions, and the small numeric kernels behind them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_power(x: Column, n: int) -> Column:
    """x^n by repeated multiplication, so integers stay exact."""
    if n < 0:
        return F.lit(1.0) / int_power(x, -n)
    out = F.lit(1)
    for _ in range(n):
        out = out * x
    return out


def binomial(n: Column, k: int) -> Column:
    """n over k for whole numbers."""
    out = F.lit(1).cast("long")
    for i in range(k):
        out = F.floor(out * (n - i) / (i + 1))
    return out


def signum(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def bisection(f: Callable[[float], float], lo: float, hi: float, target: float = 0.0, tol: float = 1e-10, most: int = 200) -> float:
    """Where a function that changes sign between lo and hi takes the target."""
    sign = math.copysign(1.0, f(hi) - target)
    if (f(lo) - target) * sign > 0:
        raise ValueError("the target isn't between the ends")
    for _ in range(most):
        mid = (lo + hi) / 2
        if hi - lo < tol:
            return mid
        lo, hi = (mid, hi) if (f(mid) - target) * sign < 0 else (lo, mid)
    return (lo + hi) / 2


# Radial basis functions of the squared distance, as Columns.


def gaussian(r2: Column, sigma: float = 1.0) -> Column:
    return F.exp(-r2 / (sigma * sigma))


def multiquadric(r2: Column, sigma: float = 1.0) -> Column:
    return F.sqrt(r2 / (sigma * sigma) + 1)


def inverse_multiquadric(r2: Column, sigma: float = 1.0) -> Column:
    return 1 / F.sqrt(r2 / (sigma * sigma) + 1)


def polyharmonic(r2: Column, k: int = 3) -> Column:
    """r^k for odd k."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    return F.pow(r2, F.lit(k / 2))


def human_memory(size: Column) -> Column:
    """Bytes in decimal units with one decimal, the next unit from 100 on."""
    text = F.lit(None).cast("string")
    for i, unit in reversed(list(enumerate(["B", "kB", "MB", "GB"]))):
        value = size / 1000.0**i
        shown = F.concat(F.format_string("%.1f", value), F.lit(f" {unit}"))
        text = shown if unit == "GB" else F.when(value < 100, shown).otherwise(text)
    return text


def split_keep(text: Column, separator: str) -> Column:
    """Pieces between separators, a trailing empty one included."""
    return F.split(text, "\\Q" + separator + "\\E", -1)


def pad(items: Column, width: int, fill: Column) -> Column:
    """A ragged array made `width` long."""
    return F.slice(F.concat(items, F.array_repeat(fill, width)), 1, width)


def rotate2(x: Column, y: Column, angle: float) -> tuple[Column, Column]:
    c, s = math.cos(angle), math.sin(angle)
    return x * c - y * s, x * s + y * c


def cell_index(p: Column, bottom: float, h: float) -> Column:
    """Cell of a uniform grid, truncated toward zero."""
    return ((p - bottom) / h).cast("int")


def de_boor(t: float, knots: list[float], control: list[list[float]], degree: int) -> list[float]:
    """A point of a spline curve by repeated linear interpolation of its control points."""
    last = len(control) - 1
    k = max(i for i in range(degree, last + 1) if knots[i] <= t or i == degree)
    d = [list(control[j + k - degree]) for j in range(degree + 1)]
    for r in range(1, degree + 1):
        for j in range(degree, r - 1, -1):
            a, b = knots[j + k - degree], knots[j + 1 + k - r]
            w = (t - a) / (b - a) if b > a else 0.0
            d[j] = [(1 - w) * u + w * v for u, v in zip(d[j - 1], d[j], strict=True)]
    return d[degree]


def nurbs(t: float, knots: list[float], control: list[list[float]], weights: list[float], degree: int) -> list[float]:
    """A rational spline: the weighted control points in one more dimension, divided out."""
    lifted = [[*(w * c for c in p), w] for p, w in zip(control, weights, strict=True)]
    *point, w = de_boor(t, knots, lifted, degree)
    return [c / w for c in point]


def gauss_legendre(n: int, lo: float = -1.0, hi: float = 1.0) -> tuple[list[float], list[float]]:
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(n)
    return ((hi - lo) / 2 * x + (hi + lo) / 2).tolist(), ((hi - lo) / 2 * w).tolist()
