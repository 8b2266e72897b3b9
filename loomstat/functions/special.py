"""Distribution tails as vectorised numpy and as column functions (Spark has neither erfc nor incomplete beta or gamma)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def _erfc(x):
    return np.frompyfunc(math.erfc, 1, 1)(x)


def _lgamma(x):
    return np.frompyfunc(math.lgamma, 1, 1)(np.asarray(x, float))


#: Median of the chi-square distribution with one degree of freedom.
CHI2_MEDIAN = 0.45493642311957283


def norm_sf(z) -> np.ndarray:
    """P(Z > z) of the standard normal."""
    z = np.asarray(z, float)
    return np.where(np.isnan(z), np.nan, 0.5 * np.asarray(_erfc(np.nan_to_num(z, nan=0.0) / math.sqrt(2)), float))


def norm_isf(p) -> np.ndarray:
    """z with P(Z > z) = p: bisection on the log of the tail, which holds down to the smallest doubles."""
    p = np.asarray(p, float)
    small = np.minimum(p, 1 - p)
    target = np.log(np.maximum(small, 5e-324))
    low, high = np.zeros(p.shape), np.full(p.shape, 39.0)
    for _ in range(70):
        mid = (low + high) / 2
        above = np.log(np.maximum(norm_sf(mid), 5e-324)) > target
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    z = np.where(p <= 0.5, high, -high)
    return np.where((p >= 0) & (p <= 1), np.where(p == 0, np.inf, np.where(p == 1, -np.inf, z)), np.nan)


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), by the continued fraction (modified Lentz), on its fast side."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    lg = lambda v: np.asarray(_lgamma(v), float)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(y) + q * np.log1p(-y)) / p
    part = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - part, part)


def t_two_sided(t, dof) -> np.ndarray:
    """P(|T| > |t|) of Student's t; NaN without a positive number of degrees of freedom."""
    t, dof = np.broadcast_arrays(np.asarray(t, float), np.asarray(dof, float))
    ok = np.isfinite(t) & (dof > 0)
    safe_t, safe_dof = np.where(ok, t, 0.0), np.where(ok, dof, 1.0)
    p = beta_tail(safe_dof / 2, np.full(t.shape, 0.5), safe_dof / (safe_dof + safe_t * safe_t))
    return np.where(ok, p, np.where(np.isinf(t) & (dof > 0), 0.0, np.nan))


def gamma_sf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): the series below a + 1, the continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    xs = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(xs) - xs - np.asarray(_lgamma(a), float))
    term, total = 1 / a, 1 / a
    b = xs + 1 - a
    c, d = np.full(x.shape, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for n in range(1, 1000):
        term = term * xs / (a + n)
        total = total + term
        an = -n * (n - a)
        b = b + 2
        d = 1 / (an * d + b)
        c = b + an / c
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-15) | (xs < a + 1)) and np.all((term < 1e-17 * total) | (xs >= a + 1)):
            break
    return np.where(x <= 0, 1.0, np.where(xs < a + 1, 1 - front * total, front * h))


def chi2_sf(x, dof) -> np.ndarray:
    """P(X > x) of chi-square; exact tails through erfc for one degree of freedom."""
    x, dof = np.broadcast_arrays(np.asarray(x, float), np.asarray(dof, float))
    ok = (x >= 0) & (dof > 0)
    xs, ds = np.where(ok, x, 0.0), np.where(ok, dof, 1.0)
    one = 2 * norm_sf(np.sqrt(xs))
    return np.where(ok, np.where(ds == 1, one, gamma_sf(ds / 2, xs / 2)), np.nan)


def chi2_1_isf(p) -> np.ndarray:
    """Chi-square value of one degree of freedom with upper tail p."""
    return norm_isf(np.asarray(p, float) / 2) ** 2


def _column(f, *columns: Column) -> Column:
    """``f`` of double columns; null in any gives null, as does NaN."""

    def run(*xs: pd.Series) -> pd.Series:
        out = f(*(x.to_numpy(float, na_value=np.nan) for x in xs))
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    kinds = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}
    one: dict = {"a": pd.Series, "return": pd.Series}
    f2 = kinds[len(columns)]
    f2.__annotations__ = one if len(columns) == 1 else {**one, "b": pd.Series}
    return F.pandas_udf(f2, "double")(*(c.cast("double") for c in columns))


def normal_p(z: Column) -> Column:
    """Two-sided normal P-value."""
    return _column(lambda z: 2 * norm_sf(np.abs(z)), z)


def t_p(t: Column, dof: Column) -> Column:
    return _column(t_two_sided, t, dof)


def chi2_p(x: Column, dof: Column) -> Column:
    return _column(chi2_sf, x, dof)


def chi2_1_quantile(p: Column) -> Column:
    """The chi-square value (one degree of freedom) whose upper tail is p."""
    return _column(chi2_1_isf, p)
