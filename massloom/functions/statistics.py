"""Distribution functions in plain Python, correlations in numpy."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    if len(x) < 2 or x.min() == x.max() or y.min() == y.max():
        return 0.0
    x, y = x - x.mean(), y - y.mean()
    return float(x @ y / math.sqrt((x @ x) * (y @ y)))


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of each row of a with each of b over the columns where neither is missing (not a number); 0 where
    one is constant there or fewer than two columns are left."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)

    def centred(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        n = m.sum(1, keepdims=True)
        flat = np.where(m, x, -np.inf).max(1, keepdims=True) == np.where(m, x, np.inf).min(1, keepdims=True)
        return np.where(m & ~flat, x - np.where(m, x, 0).sum(1, keepdims=True) / np.maximum(n, 1), 0.0)

    x, y = centred(a, ma), centred(b, mb)
    if ma.all() and mb.all():
        unit = lambda v: v / np.where((n := np.sqrt((v * v).sum(1, keepdims=True))) > 0, n, 1)
        return unit(x) @ unit(y).T
    fa, fb = ma.astype(float), mb.astype(float)
    n = np.maximum(fa @ fb.T, 1)
    sx, sy, xx, yy = x @ fb.T, fa @ y.T, (x * x) @ fb.T, fa @ (y * y).T
    vx, vy = xx - sx * sx / n, yy - sy * sy / n
    with np.errstate(all="ignore"):
        out = (x @ y.T - sx * sy / n) / np.sqrt(vx * vy)
    out = np.where((xx > 0) & (yy > 0), out, 0.0)
    # where little is left of the variance, the sums don't tell a constant from its rounding
    for i, j in np.argwhere((xx > 0) & (yy > 0) & ((vx <= 1e-6 * xx) | (vy <= 1e-6 * yy))):
        out[i, j] = _correlation(a[i], b[j])
    return out
