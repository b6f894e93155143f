"""Gradient-boosted trees for 0/1 targets on small feature tables, with calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete trees of fixed depth over quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.base = 0.0
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        share = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.arange(1, self.bins) / self.bins, method="inverted_cdf")) for c in x.T]
        b = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
        score = np.full(n, self.base)
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(inner, dtype=int), np.full(inner, np.inf)
            node = np.zeros(n, dtype=int)
            for at in range(inner):
                rows = np.nonzero(node == at)[0]
                best = (1e-9, 0, np.inf, None)
                gt, ht = g[rows].sum(), h[rows].sum()
                for k in range(m) if len(rows) > 1 else ():
                    size = len(edges[k]) + 1
                    gl = np.cumsum(np.bincount(b[rows, k], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, k], h[rows], size))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    if len(gain) and gain.max() > best[0]:
                        j = int(np.argmax(gain))
                        best = (float(gain[j]), k, float(edges[k][j]), None)
                feature[at], cut[at] = best[1], best[2]
                node[rows] = 2 * at + 1 + (x[rows, best[1]] > best[2])
            leaf = node - inner
            values = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2) * self.rate
            self.grown.append((feature, cut, values))
            score += values[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, values in self.grown:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += values[node - len(feature)]
        return out


class Calibration:
    """Isotonic map from margins to probabilities (pool adjacent violators)."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Calibration:
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []
        for m, t in zip(margin[order], y[order]):
            blocks.append([float(t), 1.0, float(m)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                t2, n2, m2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, m2]
        self.upto = np.array([b[2] for b in blocks])
        self.value = np.array([b[0] / b[1] for b in blocks])
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return self.value[np.minimum(np.searchsorted(self.upto, margin), len(self.value) - 1)]
