"""Gradient-boosted trees for small tables of features, fitted on the driver and written out as SQL."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0) -> tuple[float, list]:
    """Logistic loss, second-order gains, exact splits. A tree is a leaf's value or (feature, threshold, left, right); left is at most the threshold."""
    y = y.astype(float)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, out = np.full(len(y), base), []
    values, codes = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(rate * gs / (hs + ridge))
        if not left or len(rows) < 2 * least:
            return value
        best = (1e-6, None)
        for f in range(x.shape[1]):
            of = codes[f][rows]
            n = np.bincount(of, minlength=len(values[f]))
            has = np.flatnonzero(n)  # sums up to each value that occurs, but the last
            a, b, c = (np.cumsum(v[has])[:-1] for v in (np.bincount(of, g[rows], len(values[f])), np.bincount(of, h[rows], len(values[f])), n))
            gain = np.where((c >= least) & (c <= len(rows) - least), a**2 / (b + ridge) + (gs - a) ** 2 / (hs - b + ridge) - gs**2 / (hs + ridge), 0)
            if len(gain) and gain[i := int(gain.argmax())] > best[0]:
                best = (float(gain[i]), (f, float((values[f][has[i]] + values[f][has[i + 1]]) / 2)))
        if best[1] is None:
            return value
        f, t = best[1]
        low = x[rows, f] <= t
        return (f, t, grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        out.append(tree)
        score = score + predict_tree(tree, x)
    return base, out


def predict_tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, predict_tree(low, x), predict_tree(high, x))


def predict(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    return model[0] + sum((predict_tree(t, x) for t in model[1]), np.zeros(len(x)))


def as_sql(model: tuple[float, list], names: list[str]) -> str:
    """The model's log-odds as an SQL expression over the features ``names``."""

    def one(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        f, t, low, high = tree
        return f"IF({names[f]} <= {t!r}D, {one(low)}, {one(high)})"

    return " + ".join([f"{model[0]!r}D", *map(one, model[1])])
