"""Follow-the-regularised-leader training (McMahan et al., 2013) of sparse
logistic models, binary and multinomial, with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-Proximal; ``classes`` 1 is a binary model. A row is (indices, values)."""

    def __init__(self, dim: int, classes: int = 1, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1):
        self.shape = (dim + 1, classes)  # the last coordinate is the intercept
        self.z = np.zeros(self.shape)
        self.n = np.zeros(self.shape)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, idx: np.ndarray, val: np.ndarray, y: np.ndarray) -> None:
        i = np.append(idx, self.shape[0] - 1)
        x = np.append(val, 1.0)[:, None]
        w = self.weights(i)
        g = x * (probability((x * w).sum(0)) - y)
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - s * w
        self.n[i] += g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int, seed: int = 7) -> Ftrl:
        k = self.shape[1]
        y = np.eye(k)[labels] if k > 1 else np.asarray(labels, float)[:, None]
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            for r in rng.permutation(len(rows)):
                self.step(*rows[r], y[r])
        return self


def probability(s: np.ndarray) -> np.ndarray:
    """Softmax over the last axis, logistic where it has one entry."""
    if s.shape[-1] == 1:
        return 1 / (1 + np.exp(-np.clip(s, -35, 35)))
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that minimises held-out log loss."""
    if not len(scores):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 241))
    loss = [-np.log(np.clip(probability(scores / t)[np.arange(len(labels)), labels], 1e-12, 1)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
