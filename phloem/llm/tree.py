"""A small CART classifier in numpy."""

from __future__ import annotations

import numpy as np


class Tree:
    """Binary decision tree by Gini impurity; leaves hold the share of positives."""

    def __init__(self, depth: int = 12, least: int = 1):
        self.depth, self.least = depth, least
        self.node: tuple = ()

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.node = self._grow(np.asarray(x, dtype=float), np.asarray(y, dtype=float), self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple:
        p = y.mean()
        if depth == 0 or p in (0.0, 1.0) or len(y) < 2 * self.least:
            return (p,)
        best, found = len(y) * p * (1 - p) - 1e-12, None
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, c = x[order, j], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = c[:-1], c[-1] - c[:-1]
            impurity = left * (1 - left / n) + right * (1 - right / (len(y) - n))
            allowed = (v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least)
            if allowed.any():
                i = int(np.argmin(np.where(allowed, impurity, np.inf)))
                if impurity[i] < best:
                    best, found = impurity[i], (j, (v[i] + v[i + 1]) / 2)
        if found is None:
            return (p,)
        j, cut = found
        low = x[:, j] <= cut
        return (j, cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))

    def predict(self, row) -> float:
        node = self.node
        while len(node) > 1:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node[0]
