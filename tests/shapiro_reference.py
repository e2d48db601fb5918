"""Shapiro-Wilk W and p of one sample in memory, after AS R94 (1995); the tests compare with it."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# fixed values: polynomial coefficients of AS R94, lowest power first
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)
SMALL_GAMMA = (-2.273, 0.459)

_NORMAL = NormalDist()


def _poly(coefficients, x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def _weights(n: int) -> np.ndarray:
    """Upper-half weights, largest order statistic first."""
    ranks = np.arange(1, n // 2 + 1)
    m = np.array([-_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in ranks])
    if n == 3:
        return np.array([math.sqrt(0.5)])
    norm2 = 2 * float(m @ m)
    root = 1 / math.sqrt(n)
    weights = m.copy()
    weights[0] = _poly(LAST_WEIGHT, root) + m[0] / math.sqrt(norm2)
    fixed = 1
    if n > 5:
        weights[1] = _poly(NEXT_WEIGHT, root) + m[1] / math.sqrt(norm2)
        fixed = 2
    left = norm2 - 2 * float(m[:fixed] @ m[:fixed])
    share = 1 - 2 * float(weights[:fixed] @ weights[:fixed])
    weights[fixed:] = m[fixed:] / math.sqrt(left / share)
    return weights


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p) for 3 <= n <= 5000 values that are not all equal."""
    x = np.sort(np.asarray(values, dtype="float64"))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    x = x - x[n // 2]
    half = n // 2
    spread = x[::-1][:half] - x[:half]
    w = float(_weights(n) @ spread) ** 2 / float(((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if w == 1.0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        limit = _poly(SMALL_GAMMA, n)
        if y >= limit:
            return w, 1e-99
        y = -math.log(limit - y)
        mean, sd = _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_LOG_SD, n))
    else:
        size = math.log(n)
        mean, sd = _poly(LARGE_MEAN, size), math.exp(_poly(LARGE_LOG_SD, size))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))
