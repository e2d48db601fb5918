"""Tail probabilities of aggregated test statistics.

Spark SQL has neither erfc nor the incomplete beta function, so these run as Arrow-batched
UDFs; every step is NumPy over the whole batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _safe(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) > _TINY, v, _TINY)


def erfc(z: np.ndarray) -> np.ndarray:
    """Complementary error function: a series near zero, a continued fraction further out."""
    z = np.asarray(z, np.float64)
    near = np.minimum(np.abs(z), 2.0)
    term, total = near.copy(), near.copy()
    for k in range(1, 90):
        term = term * 2 * near * near / (2 * k + 1)
        total = total + term
    low = 1 - 2 / np.sqrt(np.pi) * np.exp(-near * near) * total
    far = np.clip(np.abs(z), 2.0, 40.0)
    fraction = far.copy()
    for k in range(120, 0, -1):
        fraction = far + (k / 2) / fraction
    high = np.exp(-far * far) / np.sqrt(np.pi) / fraction
    upper = np.where(np.abs(z) < 2, low, np.where(np.abs(z) > 38, 0.0, high))
    return np.where(np.isnan(z), np.nan, np.where(z < 0, 2 - upper, upper))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving positive ``x`` up by ten."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(10):
        shift += np.log(x + k)
    y = x + 10
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def chi_square_tail_9(x: np.ndarray) -> np.ndarray:
    """P(X > x) for chi-square variables with nine degrees of freedom."""
    x = np.maximum(np.asarray(x, np.float64), 0)
    half_series = 1 + x / 3 + x**2 / 15 + x**3 / 105
    return erfc(np.sqrt(x / 2)) + np.sqrt(2 * x / np.pi) * np.exp(-x / 2) * half_series


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1 / _safe(1 - (a + b) * x / (a + 1))
    result = d.copy()
    open_ = np.arange(len(x))
    for m in range(1, 100_000):
        if not len(open_):
            break
        p, q, v = a[open_], b[open_], x[open_]
        even = m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d[open_] = 1 / _safe(1 + term * d[open_])
            c[open_] = _safe(1 + term / c[open_])
            step = c[open_] * d[open_]
            result[open_] *= step
        open_ = open_[np.abs(step - 1) >= 1e-15]
    return result


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (a, b, x)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inside) + b * np.log1p(-inside)
    )
    left = inside < (a + 1) / (a + b + 2)
    p, q, v = np.where(left, a, b), np.where(left, b, a), np.where(left, inside, 1 - inside)
    part = front * _beta_fraction(p.ravel().copy(), q.ravel().copy(), v.ravel().copy()).reshape(p.shape) / p
    found = np.where(left, part, 1 - part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, found))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t."""
    t, df = np.asarray(t, np.float64), np.asarray(df, np.float64)
    known = ~(np.isnan(t) | np.isnan(df))
    out = np.full(t.shape, np.nan)
    square = np.where(np.isinf(t[known]), np.inf, t[known] ** 2)
    with np.errstate(invalid="ignore"):
        x = np.where(np.isinf(square), 0.0, df[known] / (df[known] + square))
    out[known] = beta_cdf(df[known] / 2, np.full(x.shape, 0.5), x)
    return out


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series) -> pd.Series:
    return pd.Series(chi_square_tail_9(x.to_numpy(np.float64)), index=x.index).where(x.notna())


@F.pandas_udf(T.DoubleType())
def welch_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(np.float64), df.to_numpy(np.float64)), index=t.index)


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z) of the standard normal distribution."""
    return pd.Series(0.5 * erfc(z.to_numpy(np.float64) / np.sqrt(2)), index=z.index).where(z.notna())
