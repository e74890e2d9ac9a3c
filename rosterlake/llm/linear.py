"""A small linear support vector machine (squared hinge loss), for samples of bounded size on the driver."""

from __future__ import annotations

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 200,
            weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear SVM; ``y`` holds booleans, both classes weigh the same. Accelerated gradient descent."""
    sign = np.where(y, 1.0, -1.0)
    weight = np.ones(len(x)) if weight is None else weight
    share = weight * np.where(y, 0.5 / max(weight[y].sum(), 1e-9), 0.5 / max(weight[~y].sum(), 1e-9))
    ones = np.ones((len(x), 1))
    z = np.hstack([x, ones]).astype(np.float64)
    bound = 1.0 / cost + 2.0 * float((share[:, None] * z * z).sum())  # of the gradient's slope
    w = np.zeros(z.shape[1])
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0.0, 1.0 - sign * (z @ ahead))
        gradient = ahead / cost - 2.0 * z.T @ (share * slack * sign)
        gradient[-1] -= ahead[-1] / cost  # the bias is free
        new = ahead - gradient / bound
        grown = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        ahead = new + (t - 1.0) / grown * (new - w)
        w, t = new, grown
    return w[:-1], float(w[-1])


def sigmoid(v):
    return 1.0 / (1.0 + np.exp(-np.clip(v, -40.0, 40.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression of few features, the bias last (Newton steps)."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    weight = weight / weight.sum()
    for _ in range(rounds):
        p = sigmoid(z @ w)
        gradient = z.T @ (weight * (p - y)) + ridge * w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-6:
            break
    return w
