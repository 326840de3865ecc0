"""Small numpy learners for models that are fitted on bounded samples on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Sparse:
    """0/1 rows given as lists of set columns."""

    rows: np.ndarray  # row of each entry
    cols: np.ndarray  # column of each entry
    shape: tuple[int, int]

    @classmethod
    def of(cls, lists: list, width: int) -> Sparse:
        n = np.array([len(x) for x in lists], np.int64)
        cols = np.concatenate([np.asarray(x, np.int64) for x in lists]) if n.sum() else np.zeros(0, np.int64)
        return cls(np.repeat(np.arange(len(lists)), n), cols, (len(lists), width))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.shape[0])

    def dot_t(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, r[self.rows], self.shape[1])

    def take(self, keep: np.ndarray) -> Sparse:
        new = np.cumsum(keep) - 1
        here = keep[self.rows]
        return Sparse(new[self.rows[here]], self.cols[here], (int(keep.sum()), self.shape[1]))


def fit_logistic(x: Sparse, dense: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 0.0, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic weights of the sparse columns and the dense columns, and the bias, by accelerated
    proximal gradient (FISTA with restarts) on mean log loss + l1*|w| + l2/2*|w|^2; the bias is free."""
    n, k, d = x.shape[0], x.shape[1], dense.shape[1]
    if n == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1.0)
        return np.zeros(k), np.zeros(d), float(np.log(rate / (1 - rate)))
    # bound of the curvature: the largest squared row norm over 4, by power iteration instead
    v, u, c, lip = np.ones(k), np.ones(d), 1.0, 1.0
    for _ in range(20):
        z = x.dot(v) + dense @ u + c
        v, u, c = x.dot_t(z) / n, dense.T @ z / n, float(z.mean())
        lip = np.sqrt((v**2).sum() + (u**2).sum() + c**2)
        v, u, c = v / lip, u / lip, c / lip
    step = 1.0 / (0.26 * lip + l2)
    rate = y.mean()
    w = np.r_[np.zeros(k + d), np.log(rate / (1 - rate))]
    s, t = w.copy(), 1.0
    for _ in range(steps):
        r = (sigmoid(x.dot(s[:k]) + dense @ s[k:-1] + s[-1]) - y) / n
        g = np.r_[x.dot_t(r), dense.T @ r, r.sum()]
        g[:-1] += l2 * s[:-1]
        new = s - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        if ((s - new) * (new - w)).sum() > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        s, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:k], w[k:-1], float(w[-1])
