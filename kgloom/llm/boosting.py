"""Boosted trees for tables of a few dozen features, trained on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Logistic boosting of binary trees of fixed depth over binned features, with a calibrated output."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    least: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    cutoff: float = 0.5

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), "i8")

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) if len(np.unique(c)) > BINS else (np.unique(c)[1:] + np.unique(c)[:-1]) / 2 for c in x.T]
        binned, p = self._bin(x), np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            self.trees.append(self._tree(binned, y - prob, np.maximum(prob * (1 - prob), 1e-6)))
            score += self._walk(self.trees[-1], binned)
        return self

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Split feature and bin of each inner node, and the value of each leaf, in heap order."""
        inner = 2**self.depth - 1
        feature, at, leaf = np.zeros(inner, int), np.full(inner, BINS + 1), np.zeros(inner + 1)
        node = np.zeros(len(g), int)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = 1e-6
            if len(own) > 1:
                gs, hs = g[own].sum(), h[own].sum()
                for j in range(x.shape[1]):
                    gl = np.cumsum(np.bincount(x[own, j], g[own], BINS + 1))[:-1]
                    hl = np.cumsum(np.bincount(x[own, j], h[own], BINS + 1))[:-1]
                    gain = np.where((hl >= self.least) & (hs - hl >= self.least), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                    if gain.max() > best:
                        best, feature[k], at[k] = gain.max(), j, int(gain.argmax())
            node[own] = 2 * k + 1 + (x[own, feature[k]] > at[k] if x.shape[1] else 0)
        for k in range(inner + 1):
            own = node == inner + k
            leaf[k] = self.rate * g[own].sum() / (h[own].sum() + 1)
        return feature, at, leaf

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, at, leaf = tree
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > at[node])
        return leaf[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum((self._walk(t, binned) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fit the output to held-out labels by logistic scaling; the cutoff has the best F1 there, nearest to a half."""
        if len(y) == 0 or y.min() == y.max():
            return self
        r, a, b = self.raw(x), 1.0, 0.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * r + b, -50, 50)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((p - t) * r).sum() + (a - 1), (p - t).sum() + b])
            hess = np.array([[(w * r * r).sum() + 1, (w * r).sum()], [(w * r).sum(), w.sum() + 1]])
            step = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
            a, b = max(0.05, a - step[0]), b - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale = (float(a), float(b))
        p = self.predict(x)
        best = (-1.0, 0.0, 0.5)
        for c in np.arange(0.05, 0.96, 0.05):
            said = p >= c
            f1 = 2 * (said & (y > 0)).sum() / max(1, said.sum() + y.sum())
            best = max(best, (float(f1), -abs(c - 0.5), float(c)))
        self.cutoff = best[2]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.raw(x) + self.scale[1], -500, 500)))
