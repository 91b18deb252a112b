"""Small logistic regressions on hashed binary features, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Rows of feature ids (a ragged array), worked on in runs of RUN ids so that no temporary grows with them."""

    RUN = 1 << 19

    def __init__(self, rows: list[np.ndarray]):
        self.n = np.array([len(r) for r in rows], np.int64)
        self.ids = np.concatenate([np.empty(0, np.int32), *rows], dtype=np.int32, casting="unsafe")
        self.of = np.repeat(np.arange(len(rows), dtype=np.int32), self.n)

    def _runs(self):
        return ((self.ids[a : a + self.RUN], self.of[a : a + self.RUN]) for a in range(0, len(self.ids), self.RUN))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n))
        for ids, of in self._runs():
            first = int(of[0])
            part = np.bincount(of - first, w[ids])
            out[first : first + len(part)] += part
        return out

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for ids, of in self._runs():
            out += np.bincount(ids, g[of], size)
        return out


def fit(rows: Rows, y: np.ndarray, size: int, steps: int = 30, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and intercept: starts from damped log count ratios of the
    features that differ by more than chance, then adaptive gradient steps on the log loss, classes
    weighted alike. One class alone gives no weights."""
    if not len(y) or y.min() == y.max():
        return np.zeros(size), 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    pos, neg = rows.back((y == 1).astype(float), size), rows.back((y == 0).astype(float), size)
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((1 - y).sum() + 2))
    ratio[np.abs(ratio) < 3 * np.sqrt(1 / (pos + 1) + 1 / (neg + 1))] = 0  # within chance
    scale = np.abs(ratio)  # features that tell nothing get no weight
    w, b = ratio * 0.1, 0.0
    seen_w, seen_b = np.full(size, 1e-3), 1e-3
    for _ in range(steps):
        g = weight * (sigmoid(rows.dot(w) + b) - y)
        gw, gb = rows.back(g, size) * scale + ridge * w, g.sum()
        seen_w += gw * gw
        seen_b += gb * gb
        w -= 0.2 * scale * gw / np.sqrt(seen_w)
        b -= 0.2 * gb / np.sqrt(seen_b)
    return w, float(b)


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Dense logistic regression with an intercept (last weight); for calibration and for combining views."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
