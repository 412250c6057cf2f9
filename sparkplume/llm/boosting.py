"""Gradient-boosted trees on the logistic loss, for a bounded training set on the driver."""

from __future__ import annotations

import numpy as np


class Trees:
    """Depth-limited trees over binned features; ``score`` is a probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32):
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        self.rate = rate
        self.trees: list[list[tuple]] = []
        if len(y) == 0 or y.min() == y.max():
            return
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        out = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-out))
            tree: list[tuple] = []
            self._grow(tree, x, y - p, p * (1 - p), np.arange(len(y)), cuts, depth)
            self.trees.append(tree)
            out += rate * self._walk(tree, x)

    def _grow(self, tree, x, slope, curve, rows, cuts, depth) -> int:
        """Append the node of these rows and its children; nodes are (feature, cut, left, right, value)."""
        at = len(tree)
        g, h = slope[rows].sum(), curve[rows].sum()
        tree.append((-1, 0.0, -1, -1, g / (h + 1)))
        if depth == 0 or len(rows) < 10:
            return at
        best = (1e-6, -1, 0.0)
        for f, limits in enumerate(cuts):
            if len(limits) == 0:
                continue
            place = np.searchsorted(limits, x[rows, f], "left")
            gl = np.cumsum(np.bincount(place, slope[rows], len(limits) + 1))[:-1]
            hl = np.cumsum(np.bincount(place, curve[rows], len(limits) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, limits[k])
        _, f, cut = best
        if f < 0:
            return at
        low = x[rows, f] <= cut
        if low.all() or not low.any():
            return at
        left = self._grow(tree, x, slope, curve, rows[low], cuts, depth - 1)
        right = self._grow(tree, x, slope, curve, rows[~low], cuts, depth - 1)
        tree[at] = (f, cut, left, right, 0.0)
        return at

    @staticmethod
    def _walk(tree, x) -> np.ndarray:
        out = np.zeros(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            f, cut, left, right, value = tree[node]
            if f < 0:
                out[rows] = value
                continue
            low = x[rows, f] <= cut
            stack += [(left, rows[low]), (right, rows[~low])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._walk(tree, x)
        return 1 / (1 + np.exp(-out))
