"""Logistic regression on hashed features, and probability calibration; for fits on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_sparse(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, dims: int, rounds: int = 150, rate: float = 0.5, penalty: float = 1e-5, run: int = 256) -> tuple[np.ndarray, float]:
    """Weights and bias for rows given as (index, value); Adagrad over all rows, both classes weighted alike.

    Rows are gone through some hundred at a time, so that little is held beside the rows themselves."""
    runs = []
    for k in range(0, len(rows), run):
        part = rows[k : k + run]
        sizes = [len(i) for i, _ in part]
        runs.append((slice(k, k + len(part)), np.concatenate([i for i, _ in part]), np.concatenate([v for _, v in part]), np.repeat(np.arange(len(part), dtype=np.int32), sizes)))
        rows[k : k + run] = [None] * len(part)  # held once
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    w, bias = np.zeros(dims), 0.0
    square, square_b = np.full(dims, 1e-12), 1e-12
    for _ in range(rounds):
        grad, g = penalty * w, 0.0
        for at, index, value, row in runs:
            z = np.bincount(row, value * w[index], at.stop - at.start) + bias
            slope = share[at] * (sigmoid(z) - label[at])
            grad += np.bincount(index, value * slope[row], dims)
            g += slope.sum()
        square += grad * grad
        w -= rate * grad / np.sqrt(square)
        square_b += g * g
        bias -= rate * g / np.sqrt(square_b)
    return w, float(bias)


def fit_dense(x: np.ndarray, label: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Weights of the columns of `x` and a bias (last) for the probability of label 1.

    Newton steps with Platt's smoothed targets on columns brought to one scale; a step is halved until it helps.
    """
    ones, zeros = int((label == 1).sum()), int((label == 0).sum())
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    theta = np.zeros(z.shape[1])
    damp = ridge * len(x) * np.eye(len(theta))

    def loss(t):
        u = z @ t
        return (np.logaddexp(0, u) - target * u).sum() + 0.5 * t @ damp @ t

    for _ in range(rounds):
        p = sigmoid(z @ theta)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + damp
        step = np.linalg.solve(hessian, z.T @ (p - target) + damp @ theta)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    weights = theta[:-1] / scale
    return np.append(weights, theta[-1] - weights @ mean)


def calibrate(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a z + b) is the probability of label 1."""
    a, b = fit_dense(z[:, None], label)
    return float(a), float(b)
