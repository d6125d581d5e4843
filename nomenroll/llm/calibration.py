"""Raw scores to probabilities, from a histogram of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2048


def histogram(scored: DataFrame, score: str, label: str, low: float, high: float, bins: int = BINS) -> np.ndarray:
    """Rows (mean score, labels, rows) of the bins that have rows; a map-side combined count of ``bins`` keys."""
    at = F.floor((F.least(F.greatest(F.col(score), F.lit(low)), F.lit(high)) - low) * (bins / (high - low)))
    rows = scored.groupBy(at.alias("bin")).agg(F.avg(score).alias("x"), F.sum(label).alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    return np.array([(r["x"], r["y"], r["n"]) for r in rows], dtype=np.float64).reshape(-1, 3)


class Isotonic:
    """Pool adjacent violators: level inside a pool, a straight line from a pool's end to the next one's start, and a
    trace of the raw score, so that order inside a pool stays. Never 0 or 1."""

    def __init__(self, bins: np.ndarray):
        pools: list[list[float]] = []  # first score, last score, labels, rows
        for x, y, n in bins:
            pools.append([x, x, y, n])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                _, last, y, n = pools.pop()
                pools[-1] = [pools[-1][0], last, pools[-1][2] + y, pools[-1][3] + n]
        table = np.array(pools or [[0.0, 0.0, 0.5, 1.0]])
        level = np.maximum.accumulate((table[:, 2] + 0.5) / (table[:, 3] + 1))
        self.x, self.y = table[:, :2].ravel(), np.repeat(level, 2)

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return 0.999 * np.interp(scores, self.x, self.y) + 0.001 / (1 + np.exp(-np.clip(scores, -30, 30)))


class Logistic:
    """Two parameters, fitted to smoothed labels by Newton steps."""

    def __init__(self, bins: np.ndarray):
        self.a, self.b = 1.0, 0.0
        if not len(bins):
            return
        x, y, n = bins.T
        ones, zeros = y.sum(), (n - y).sum()
        target = (y * (ones + 1) / (ones + 2) + (n - y) / (zeros + 2)) / n
        rows = np.stack([x, np.ones_like(x)], axis=1)
        theta = np.array([0.0, np.log((ones + 1) / (zeros + 1))])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
            slope = rows.T @ (n * (target - p)) - 1e-3 * theta
            curve = (rows * (n * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
            step = np.linalg.solve(curve, slope)
            theta = theta + np.clip(step, -2, 2)
        self.a, self.b = max(float(theta[0]), 1e-6), float(theta[1])

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * scores + self.b, -30, 30)))
