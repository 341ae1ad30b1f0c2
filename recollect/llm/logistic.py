"""Logistic regression in numpy, for the small design matrices of bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, steps: int = 25) -> Logistic:
        """Newton steps with an L2 penalty. One class, or no rows, gives its (smoothed) rate for every row."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        n, d = x.shape
        weight = np.ones(n) if weight is None else weight
        mean = x.mean(0) if n else np.zeros(d)
        scale = x.std(0) if n else np.ones(d)
        scale = np.where(scale > 1e-9, scale, 1.0)
        rate = (weight @ y + 1) / (weight.sum() + 2) if n else 0.5
        w = np.zeros(d + 1)
        w[-1] = np.log(rate / (1 - rate))
        if n and 0 < y.sum() < n:
            z = np.hstack([(x - mean) / scale, np.ones((n, 1))])
            ridge = np.full(d + 1, penalty)
            ridge[-1] = 1e-6
            for _ in range(steps):
                p = sigmoid(z @ w)
                r = weight * np.maximum(p * (1 - p), 1e-6)
                step = np.linalg.solve((z.T * r) @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
                w += step
                if np.abs(step).max() < 1e-6:
                    break
        return Logistic(mean, scale, w[:-1], float(w[-1]))
