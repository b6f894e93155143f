"""Generalised additive model with pairwise interactions, for 0/1 targets.

Terms are lookup tables over quantile bins.  They are learned by cyclic
boosting: round after round, each feature in turn gets a shallow tree on the
current gradients, whose leaf values are added to that feature's table.  The
pairs with the largest remaining gain then get two-way tables the same way.
Scoring is a sum of table entries picked by bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins (cut before the place)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
    gain[(hl < 1.0) | (hr < 1.0)] = 0
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Leaf values by bin of a one-feature tree grown best gain first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_cut(g[a:b], h[a:b], l2), k) for k, (a, b) in enumerate(parts) if b - a > 1]
        gain, at, k = max(cuts, default=(0.0, 0, 0))
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + at), (a + at, b)]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best two-cut tree over a table of bins."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gr, hr = gc[:-1, -1:], hc[:-1, -1:]
    gk, hk = gc[-1:, :-1], hc[-1:, :-1]
    a, ha = gc[:-1, :-1], hc[:-1, :-1]
    total, htotal = gc[-1, -1], hc[-1, -1]
    cells = [(a, ha), (gr - a, hr - ha), (gk - a, hk - ha), (total - gr - gk + a, htotal - hr - hk + ha)]
    gain = sum(x**2 / (y + l2) for x, y in cells) - total**2 / (htotal + l2)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [-x[i, j] / (y[i, j] + l2) for x, y in cells]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = value[0], value[1]
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value[2], value[3]
    return float(gain[i, j]), out


@dataclass
class PairwiseGam:
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    leaves: int = 3
    l2: float = 1.0
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def _binned(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        """x (rows, features), y 0/1.  No rows or one class: a constant score."""
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        base = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(base / (1 - base)))
        if not len(y) or y.min() == y.max():
            return self
        quantiles = lambda n: [np.unique(np.quantile(c, np.arange(1, n) / n)) for c in x.T]
        self.edges, self.pair_edges = quantiles(self.bins), quantiles(self.pair_bins)
        b, p = self._binned(x, self.edges), self._binned(x, self.pair_edges)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for k, t in enumerate(self.tables):
                prob = _sigmoid(score)
                g = np.bincount(b[:, k], prob - y, len(t))
                h = np.bincount(b[:, k], prob * (1 - prob), len(t))
                step = self.rate * _shallow_tree(g, h, self.leaves, self.l2)
                t += step
                score += step[b[:, k]]
        shape = lambda i, j: (len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)

        def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            prob, (n, m) = _sigmoid(score), shape(i, j)
            cell = p[:, i] * m + p[:, j]
            return np.bincount(cell, prob - y, n * m).reshape(n, m), np.bincount(cell, prob * (1 - prob), n * m).reshape(n, m)

        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -_quadrants(*sums(*ij), self.l2)[0])
        self.pair_tables = {ij: np.zeros(shape(*ij)) for ij in ranked[: self.pairs]}
        for _ in range(self.pair_rounds):
            for (i, j), t in self.pair_tables.items():
                _, step = _quadrants(*sums(i, j), self.l2)
                t += self.rate * step
                score += self.rate * step[p[:, i], p[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 by row."""
        x = np.asarray(x, dtype=float)
        out = np.full(len(x), self.intercept)
        if self.tables:
            b, p = self._binned(x, self.edges), self._binned(x, self.pair_edges)
            for k, t in enumerate(self.tables):
                out += t[b[:, k]]
            for (i, j), t in self.pair_tables.items():
                out += t[p[:, i], p[:, j]]
        return _sigmoid(out)
