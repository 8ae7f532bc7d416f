"""Gradient-boosted regression trees for logistic loss, in numpy, for a bounded training sample on the driver."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of a fixed depth, split on quantile bins; a leaf that can't be split repeats its value."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base = 0.0
        self.features = self.cuts = self.values = np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features, y: 0 or 1."""
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score, inner = np.full(len(y), self.base), 2**self.depth - 1
        features, cuts, values = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            at = np.zeros(len(y), int)
            feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                if len(rows):
                    feature[node], cut[node] = self._split(codes[rows], grad[rows], hess[rows], edges)
                    at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + self.least)
            score += value[leaf]
            features.append(feature)
            cuts.append(cut)
            values.append(value)
        self.features, self.cuts, self.values = np.array(features), np.array(cuts), np.array(values)
        return self

    def _split(self, codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float]:
        best, feature, cut = 1e-6, 0, np.inf
        g, h = grad.sum(), hess.sum()
        for f, e in enumerate(edges):
            if not len(e):
                continue
            left_g, left_h = (np.bincount(codes[:, f], w, len(e) + 1).cumsum()[:-1] for w in (grad, hess))
            gain = left_g**2 / (left_h + self.least) + (g - left_g) ** 2 / (h - left_h + self.least) - g * g / (h + self.least)
            k = int(gain.argmax())
            if gain[k] > best:
                best, feature, cut = gain[k], f, e[k]
        return feature, cut

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += value[at - (2**self.depth - 1)]
        return score
