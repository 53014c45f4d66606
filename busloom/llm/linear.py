"""Small linear models fitted on a bounded sample: support vector machines and score calibration."""

from __future__ import annotations

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Linear support vector machine for y in {-1, 1}: squared hinge loss, classes weighted alike, accelerated gradient steps."""
    n, k = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    probe = np.full(k, k**-0.5, x.dtype)
    for _ in range(15):  # the largest curvature, by power iteration
        probe = x.T @ (weight * (x @ probe))
        curve = float(np.linalg.norm(probe)) or 1.0
        probe /= curve
    step = 0.5 / (curve + 1.0 + strength)
    w, b = np.zeros(k, x.dtype), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead_w + ahead_b)) * weight * y
        new_w = ahead_w + step * 2 * (x.T @ slack - strength * ahead_w)
        new_b = ahead_b + step * 2 * float(slack.sum())
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w, ahead_b = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def calibrate(margin: np.ndarray, positive: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve that maps margins to probabilities, with Platt's smoothed targets.

    The slope is never negative; without both classes it is 0 and the curve is the smoothed share.
    """
    weight = np.ones(len(margin)) if weight is None else weight
    up, down = float(weight[positive].sum()), float(weight[~positive].sum())
    share = (up + 1) / (up + down + 2)
    if not (positive.any() and (~positive).any()):
        return 0.0, float(np.log(share / (1 - share)))
    target = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    scale = float(np.abs(margin).std() or np.abs(margin).max() or 1.0)
    x = np.stack([margin / scale, np.ones(len(margin))], 1)
    beta = np.array([1.0, np.log(share / (1 - share))])
    ridge = np.diag([1e-6, 1e-9]) * weight.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + ridge @ beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        move = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    if beta[0] < 0:
        return 0.0, float(np.log(share / (1 - share)))
    return float(beta[0] / scale), float(beta[1])


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -700, 700))))


def rising_curve(margin: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the weighted isotonic regression of ``positive`` on ``margin``; empty without data.

    Neighbours that violate the order are pooled.  A pool is level from its least to its largest
    margin and has its share as value, smoothed if it is pure; between pools the curve is straight.
    """
    pools: list[list[float]] = []  # weight, weighted positives, least and largest margin
    for i in np.argsort(margin, kind="stable"):
        pools.append([weight[i], weight[i] * positive[i], margin[i], margin[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    knots, values = [], []
    for total, up, least, largest in pools:
        if total > 0:
            value = (up + 0.5) / (total + 1) if up in (0, total) else up / total
            for x in dict.fromkeys((float(least), float(largest))):
                knots.append(x)
                values.append(float(value))
    return knots, values
