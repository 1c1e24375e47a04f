"""Small models trained on the driver from bounded samples, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def linear_svms(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Squared hinge loss, by accelerated gradient descent, of a machine for each column of y (-1
    or 1) and weight. Returns a column of weights and a bias for each."""
    weight = weight / weight.sum(axis=0)
    w = v = np.zeros((x.shape[1] + 1, y.shape[1]), x.dtype)
    step = x.dtype.type(1 / (2 * (np.max(np.einsum("ij,ij->i", x, x)) + 1) + l2))
    l2 = x.dtype.type(l2)
    for t in range(rounds):
        pull = weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        new = v - step * (l2 * v - 2 * np.vstack([x.T @ pull, pull.sum(axis=0)]))
        v = new + x.dtype.type(t / (t + 3)) * (new - w)
        w = new
    return w[:-1], w[-1]


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """The logistic curve through margins; y: 0 or 1, softened by one example of either kind."""
    z = np.c_[margin, np.ones(len(margin))]
    goal = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(z @ w)
        h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, z.T @ (p - goal))
    return float(max(w[0], 1e-3)), float(w[1])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Regularised logistic regression by Newton's method. y: 0 or 1."""
    z = np.c_[x, np.ones(len(x))]
    ridge = np.diag(np.r_[np.full(x.shape[1], l2), 1e-9])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = sigmoid(z @ w)
        g = z.T @ (p - y) / len(y) + ridge @ w
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z / len(y) + ridge
        move = np.linalg.solve(h, g)
        w = w - move / max(1, np.abs(move).max() / 3)
    return w[:-1], float(w[-1])
