"""Numeric expressions; the spline basis is the only one that needs a vectorised UDF."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def row_sum(cols: list[str]) -> Column:
    """Sum over columns, nulls counting as 0; 0 where all are null."""
    return _sum([F.coalesce(F.col(c), F.lit(0.0)) for c in cols])


def residual_share(known: list[str]) -> Column:
    return F.lit(1.0) - row_sum(known)


def sum0(c: Column) -> Column:
    """Aggregate sum whose value over no known rows is 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_ratio(p: Column, reference: Column) -> Column:
    return F.log(p / reference)


def entry_exit_weight(t: Column, enters: Column, leaves: Column, rate: Column,
                      always_entered: Column | None = None,
                      never_exited: Column | None = None) -> Column:
    """Smooth presence weight: rises around ``enters``, falls around ``leaves``.

    The flags (0 or 1) switch a side off: a party that was always there does not rise, one that
    never left does not fall.
    """
    a = F.lit(0) if always_entered is None else always_entered
    b = F.lit(0) if never_exited is None else never_exited
    rise = a + (1 - a) * logistic(rate * (t - enters))
    fall = b + (1 - b) * logistic(-rate * (t - leaves))
    return rise * fall


def blend(w: Column, x: Column, other: Column) -> Column:
    return w * x + (F.lit(1.0) - w) * other


def floor_share(base: Column, floating: Column) -> Column:
    return (F.lit(1.0) - floating) * base


def ceiling_share(base: Column, floating: Column) -> Column:
    return floor_share(base, floating) + floating


def floating_mix(base: Column, floating: Column, dynamic: Column) -> Column:
    return floor_share(base, floating) + floating * dynamic


def standardised_residual(observed: Column, expected: Column) -> Column:
    return (observed - expected) / F.sqrt(expected * (F.lit(1.0) - expected))


def absorbed_correlation(rho_r: Column, rho_j: Column, p_r: Column, p_j: Column) -> Column:
    """Correlation with the residual after it absorbs party j: share-weighted mean."""
    return (rho_r * p_r + rho_j * p_j) / (p_r + p_j)


def absorbed_sigma(sigma_r: Column, sigma_j: Column, p_r: Column, p_j: Column) -> Column:
    """Spread of the residual after it absorbs party j: pooled with squared shares."""
    total = p_r + p_j
    return F.sqrt((p_r * p_r * sigma_r * sigma_r + p_j * p_j * sigma_j * sigma_j)
                  / (total * total))


def interval_index(x: Column, breaks: list, rightmost_closed: bool = False) -> Column:
    """Number of breaks at or below ``x``, for breaks that follow no rule; 0 below the first.

    With ``rightmost_closed`` a value equal to the last break belongs to the interval before it.
    """
    points = F.array(*[F.lit(b) for b in sorted(breaks)])
    i = F.when(x.isNotNull(), F.size(F.filter(points, lambda b: b <= x)))
    if not rightmost_closed or len(breaks) < 2:
        return i
    return F.when(x == F.lit(max(breaks)), len(breaks) - 1).otherwise(i)


def list_position(x: Column, levels: list[str]) -> Column:
    """Position of a label in a given list, to sort by; null for other labels."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), x), F.lit(0))


def is_close(actual: Column, desired: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(actual - desired) <= F.lit(atol) + F.lit(rtol) * F.abs(desired)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def horizon_bin(h: Column, edges: tuple[int, ...] = (4, 12, 26)) -> Column:
    """Label a horizon: ``fit`` up to 0, then closed-right bins, open at the end."""
    out = F.when(h <= 0, F.lit("fit"))
    low = 1
    for e in edges:
        out = out.when(h <= e, F.lit(f"{low}-{e}w"))
        low = e + 1
    return out.when(h > edges[-1], F.lit(f">{edges[-1]}w"))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax_array(a: Column) -> Column:
    """Softmax over the elements of an array column, shifted by its maximum."""
    def scale(e: Column) -> Column:
        return bind(array_sum(e), lambda total: F.transform(e, lambda x: x / total))

    return bind(F.array_max(a), lambda top: bind(
        F.transform(a, lambda x: F.exp(x - top)), scale))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def lgamma(x: Column) -> Column:
    """Log gamma for x > 0, JVM-side: Stirling's series after shifting the argument up by 8."""
    x = x.cast("double")
    z = x + 8
    z2 = z * z
    series = (
        (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
        + (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / z2) / z2) / z2) / z2) / z
    )
    shift = x
    for k in range(1, 8):
        shift = shift * (x + k)
    return series - F.log(shift)


def multinomial_log_score(y: Column, p: Column, n: Column) -> Column:
    """Aggregate: log probability of counts ``y`` of one poll with total ``n``."""
    return lgamma(F.first(n) + 1) + F.sum(
        F.when(y > 0, y * F.log(p)).otherwise(0.0) - lgamma(y + 1))


def dirichlet_multinomial_log_score(y: Column, a: Column) -> Column:
    """Aggregate: log probability of counts ``y`` under concentrations ``a``."""
    n, total = F.sum(y), F.sum(a)
    return (
        lgamma(n + 1) + lgamma(total) - lgamma(n + total)
        + F.sum(lgamma(y + a) - lgamma(a) - lgamma(y + 1))
    )


def poisson_log_score(y: Column, rate: Column) -> Column:
    return y * F.log(rate) - rate - lgamma(y + 1)


def bspline_rows(t: np.ndarray, knots: list[float], low: float, high: float,
                 degree: int = 3) -> np.ndarray:
    """Basis values (len(t) x len(knots)+degree+1) of a clamped B-spline, by recursion on order."""
    grid = np.concatenate([[low] * (degree + 1), sorted(knots), [high] * (degree + 1)])
    t = np.asarray(t, dtype=float)
    n = len(grid) - 1
    last = np.searchsorted(grid, high, side="left") - 1
    basis = np.zeros((len(t), n))
    cell = np.clip(np.searchsorted(grid, t, side="right") - 1, degree, last)
    basis[np.arange(len(t)), cell] = 1.0
    for d in range(1, degree + 1):
        nxt = np.zeros((len(t), n - d))
        for i in range(n - d):
            wl, wr = grid[i + d] - grid[i], grid[i + d + 1] - grid[i + 1]
            if wl > 0:
                nxt[:, i] += (t - grid[i]) / wl * basis[:, i]
            if wr > 0:
                nxt[:, i] += (grid[i + d + 1] - t) / wr * basis[:, i + 1]
        basis = nxt
    return basis


def bspline_basis(t: Column, knots: list[float], low: float, high: float,
                  degree: int = 3) -> Column:
    """Basis row of ``t`` as an array column."""

    @F.pandas_udf("array<double>")
    def rows(s: pd.Series) -> pd.Series:
        return pd.Series(list(bspline_rows(s.to_numpy(), knots, low, high, degree)))

    return rows(t)
