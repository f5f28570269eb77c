"""Gradient-boosted trees with logistic loss and isotonic calibration, in numpy, for dense features and bounded samples."""

from __future__ import annotations

import numpy as np


class Isotonic:
    """A non-decreasing step function fitted by pooling adjacent violators."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        order = np.argsort(x, kind="stable")
        level: list[list[float]] = []  # [mean, weight, from]
        for v, t, k in zip(x[order], y[order], w[order]):
            if level and level[-1][2] == v:  # equal scores are one point
                m = level.pop()
                t, k = (m[0] * m[1] + t * k) / (m[1] + k), m[1] + k
            level.append([float(t), float(k), float(v)])
            while len(level) > 1 and level[-2][0] >= level[-1][0]:
                b, a = level.pop(), level.pop()
                level.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2]])
        self.at = np.array([p[2] for p in level] or [0.0])
        self.value = np.array([p[0] for p in level] or [0.0])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.clip(np.searchsorted(self.at, x, "right") - 1, 0, None)]


class Boosted:
    """``rounds`` trees of ``depth`` levels over feature thresholds; ``score`` is the raw sum, ``probability`` the calibrated value."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, least: float = 3.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.trees: list[list[tuple]] = []
        self.base, self.calibration = 0.0, None

    def _grow(self, bins, cuts, g, h, rows, level):
        """``bins``: for each row and feature, feature * width + number of cuts below the value."""
        G, H = g[rows].sum(), h[rows].sum()
        leaf = ("leaf", -self.rate * G / (H + self.ridge))
        if level == self.depth or len(rows) < 2 * self.least:
            return leaf
        n_feat, width = len(cuts), self.width
        at = bins[rows].ravel()
        wide = lambda v: np.bincount(at, np.repeat(v, n_feat), n_feat * width).reshape(n_feat, width).cumsum(axis=1)
        gl, hl, n = wide(g[rows]), wide(h[rows]), wide(np.ones(len(rows)))
        gain = gl**2 / (hl + self.ridge) + (G - gl) ** 2 / (H - hl + self.ridge) - G * G / (H + self.ridge)
        gain[(n < self.least) | (len(rows) - n < self.least)] = 0
        f, c = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, c] <= 1e-6 or c >= len(cuts[f]):
            return leaf
        go = bins[rows, f] <= f * width + c
        return ("split", int(f), float(cuts[f][c]), self._grow(bins, cuts, g, h, rows[go], level + 1), self._grow(bins, cuts, g, h, rows[~go], level + 1))

    def _apply(self, tree, x, rows, out):
        if tree[0] == "leaf":
            out[rows] += tree[1]
            return
        go = x[rows, tree[1]] <= tree[2]
        self._apply(tree[3], x, rows[go], out)
        self._apply(tree[4], x, rows[~go], out)

    def _boost(self, x, y, w):
        self.trees, p = [], np.clip(np.average(y, weights=w), 0.01, 0.99)
        self.base = float(np.log(p / (1 - p)))
        s = np.full(len(y), self.base)
        cuts = [np.unique(np.r_[np.quantile(col, np.linspace(0.02, 0.98, 12), method="nearest"), np.unique(col)[:4]]) for col in x.T]
        self.width = 1 + max(map(len, cuts))
        bins = np.stack([np.searchsorted(c, col, "left") + k * self.width for k, (c, col) in enumerate(zip(cuts, x.T))], axis=1)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-s))
            tree = self._grow(bins, cuts, w * (q - y), w * q * (1 - q), np.arange(len(y)), 0)
            self.trees.append(tree)
            self._apply(tree, x, np.arange(len(y)), s)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, folds: int = 4) -> "Boosted":
        """Fits the trees, and the calibration on scores of held-out folds."""
        held = np.zeros(len(y))
        fold = np.arange(len(y)) % folds
        for k in range(folds):
            a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(b) and len(np.unique(y[a] > 0.5)) == 2:
                m = Boosted(self.rounds, self.depth, self.rate, self.least, self.ridge)
                m._boost(x[a], y[a], w[a])
                held[b] = m.score(x[b])
        self._boost(x, y, w)
        self.calibration = Isotonic(held, y, w)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            self._apply(t, x, np.arange(len(x)), out)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.score(x)), 0.0, 1.0)
