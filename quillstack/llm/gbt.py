"""Gradient-boosted trees with monotonic constraints, flattened into numpy node arrays.

Training runs on the driver over a bounded sample. Scoring walks all rows of a batch down all
levels of a tree at once; a leaf points to itself, so each tree takes ``depth`` steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees end to end. A row goes left where its feature is below the cut."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x`` (rows, features)."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                below = x[row, self.feature[at]] < self.cut[at]
                at = np.where(below, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def least(self, low: np.ndarray) -> float:
        """A bound from below on the score of every row whose features are all at least ``low``."""

        def of(node: int) -> float:
            if self.left[node] == node:
                return float(self.value[node])
            sides = [of(self.right[node])]
            if low[self.feature[node]] < self.cut[node]:
                sides.append(of(self.left[node]))
            return min(sides)

        return self.base + sum(of(int(r)) for r in self.roots)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, penalty: float = 1.0, least_rows: int = 5) -> Forest:
    """Logistic boosting with histogram splits.

    ``monotone`` has +1, -1 or 0 for each feature: a split on a constrained feature is taken only if
    its sides are in order, and the middle of their values then bounds everything below them, so the
    score as a whole is monotone. No rows, or one class alone, give the constant forest.
    """
    n, width = x.shape
    rate0 = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate0 / (1 - rate0)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.array([]) for f in range(width)]
    code = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], 1) if n else np.zeros((0, width), int)
    nodes: list[list[float]] = []
    roots: list[int] = []
    raw = np.full(n, base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left: int) -> int:
        me = len(nodes)
        worth = float(np.clip(g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([0, 0.0, me, me, worth * rate])
        best: tuple[float, int, int, float, float] | None = None
        if left and len(rows) >= 2 * least_rows:
            for f in range(width):
                if not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                gs = np.bincount(code[rows, f], g[rows], size).cumsum()[:-1]
                hs = np.bincount(code[rows, f], h[rows], size).cumsum()[:-1]
                ns = np.bincount(code[rows, f], minlength=size).cumsum()[:-1]
                gt, ht = g[rows].sum(), h[rows].sum()
                a = np.clip(gs / (hs + penalty), low, high)
                b = np.clip((gt - gs) / (ht - hs + penalty), low, high)
                gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                fine = (ns >= least_rows) & (len(rows) - ns >= least_rows) & ((b - a) * monotone[f] >= 0)
                if fine.any():
                    k = int(np.argmax(np.where(fine, gain, -np.inf)))
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = float(gain[k]), f, k, float(a[k]), float(b[k])
        if best:
            _, f, k, a_, b_ = best
            goes = code[rows, f] <= k
            mid = (a_ + b_) / 2
            bound = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[f]]
            one = grow(rows[goes], g, h, *bound[0], left - 1)
            two = grow(rows[~goes], g, h, *bound[1], left - 1)
            nodes[me] = [f, float(cuts[f][k]), one, two, 0.0]
        return me

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            roots.append(grow(np.arange(n), y - p, p * (1 - p), -8.0, 8.0, depth))
            flat = _flat(nodes, [roots[-1]], depth, 0.0)
            raw += flat.score(x)
    return _flat(nodes, roots, depth, base)


def _flat(nodes: list[list[float]], roots: list[int], depth: int, base: float) -> Forest:
    table = np.array(nodes, float).reshape(-1, 5)
    return Forest(np.array(roots, np.int64), table[:, 0].astype(np.int64), table[:, 1].copy(), table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4].copy(), depth, base)
