"""Gradient-boosted trees for two classes in numpy: shallow trees over binned features, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth; each inner node asks whether a feature exceeds a threshold."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if not len(y):
            return self
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                self._split(level, node, binned, edges, grad, hess, feature, threshold)
            g, h = (np.bincount(node, v, 2**self.depth) for v in (grad, hess))
            leaf = self.rate * g / (h + self.ridge)
            score += leaf[node]
            for kept, new in ((self.features, feature), (self.thresholds, threshold), (self.leaves, leaf)):
                kept.append(new)
        return self

    def _split(self, level, node, binned, edges, grad, hess, feature, threshold) -> None:
        """The best cut of each node of a level; moves node to the children's numbers."""
        count, width = 2**level, self.bins + 1
        best = np.full(count, 1e-9)
        cut = np.full(count, width)
        g_all, h_all = (np.bincount(node, v, count) for v in (grad, hess))
        pick = np.zeros(count, np.int64)
        for j in range(binned.shape[1]):
            cell = node * width + binned[:, j]
            g, h = (np.bincount(cell, v, count * width).reshape(count, width).cumsum(1) for v in (grad, hess))
            rest_g, rest_h = g_all[:, None] - g, h_all[:, None] - h
            gain = g**2 / (h + self.ridge) + rest_g**2 / (rest_h + self.ridge) - (g_all**2 / (h_all + self.ridge))[:, None]
            gain[:, len(edges[j]) :] = 0
            at = gain.argmax(1)
            top = gain[np.arange(count), at]
            better = top > best
            best, cut, pick = np.where(better, top, best), np.where(better, at, cut), np.where(better, j, pick)
        for k in range(count):
            if cut[k] < width:
                feature[count - 1 + k], threshold[count - 1 + k] = pick[k], edges[pick[k]][cut[k]]
        node[:] = 2 * node + (binned[np.arange(len(node)), pick[node]] > cut[node])

    def logit(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = 2 * node + (x[rows, feature[at]] > threshold[at])
            score += leaf[node]
        return score
