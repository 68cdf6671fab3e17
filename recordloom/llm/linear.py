"""Logistic regression on a bounded matrix, and its calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Coefficients, the intercept last, by accelerated gradient steps; the loss is the weighted mean plus a ridge."""
    x = np.asarray(x, np.float32)
    weight = weight / weight.sum()
    beta = np.zeros(x.shape[1] + 1)
    ahead, t = beta.copy(), 1.0
    # The largest curvature of the loss, by a few power iterations.
    v = np.ones(x.shape[1] + 1) / np.sqrt(x.shape[1] + 1)
    top = 1.0
    for _ in range(12):
        u = weight * (x @ v[:-1].astype(np.float32) + v[-1])
        v = np.append(x.T @ u.astype(np.float32), u.sum())
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1.0 / (0.27 * top + ridge)
    for _ in range(steps):
        r = weight * (sigmoid(x @ ahead[:-1].astype(np.float32) + ahead[-1]) - y)
        grad = np.append(x.T @ r.astype(np.float32), r.sum())
        grad[:-1] += ridge * ahead[:-1]
        following = ahead - rate * grad
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = following + (before - 1) / t * (following - beta)
        beta = following
    return beta


def fit_platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is a probability; targets are smoothed as Platt proposed, a stays positive."""
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    up, down = float(weight[y > 0].sum()), float(weight[y <= 0].sum())
    if not up or not down:
        return 1.0, 0.0
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    ab = np.array([1.0, 0.0])
    for _ in range(60):
        p = sigmoid(ab[0] * score + ab[1])
        r, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([(r * score).sum() + 1e-3 * (ab[0] - 1), r.sum()])
        curve = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(curve, grad)
        ab = ab - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])
