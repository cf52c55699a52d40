"""Logistic regression for models fitted on a bounded number of rows, and its exact parts."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the last one the intercept, by Newton's method. ``y`` may be probabilities."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, grad)
        w = w - step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_sparse(rows: np.ndarray, columns: np.ndarray, n_columns: int, y: np.ndarray, l2: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Weights of binary features given as (row, column) pairs, the last one the intercept.

    Gradient descent with a step of its own for every weight (AdaGrad); deterministic.
    """
    w, seen = np.zeros(n_columns + 1), np.full(n_columns + 1, 1e-8)
    prior = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w[-1] = np.log(prior / (1 - prior))
    for _ in range(rounds):
        z = np.bincount(rows, w[columns], len(y)) + w[-1]
        error = sigmoid(z) - y
        grad = np.append(np.bincount(columns, error[rows], n_columns) + l2 * w[:-1], error.sum())
        seen += grad * grad
        w -= 0.5 * grad / np.sqrt(seen)
    return w


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities."""
    if len(y) < 10 or y.min() == y.max():
        return 1.0, 0.0
    a, b = fit_dense(score[:, None], y, l2=1e-3)
    return float(a), float(b)
