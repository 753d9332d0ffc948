"""Small numpy learners for the driver: their inputs are bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 0.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by accelerated proximal gradient steps.

    The loss is a mean, so l1 and l2 don't depend on the number of rows. No rows: zeros.
    """
    n, d = x.shape
    if n == 0:
        return np.zeros(d), 0.0
    x1 = np.ones((n, d + 1))
    x1[:, :d] = x
    v = np.ones(d + 1)
    for _ in range(12):  # the largest eigenvalue bounds the curvature
        v = x1.T @ (x1 @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (0.25 * 1.1 * float(np.linalg.norm(x1 @ v) ** 2) / n + l2 + 1e-9)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w = np.zeros(d + 1)
    w[-1] = np.log(rate / (1 - rate))
    z, t = w.copy(), 1.0
    for _ in range(steps):
        g = x1.T @ (sigmoid(x1 @ z) - y) / n
        g[:-1] += l2 * z[:-1]
        new = z - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])
