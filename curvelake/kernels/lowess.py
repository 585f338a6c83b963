"""Robust locally weighted regression (Cleveland, 1979) in numpy, each point over the window of its neighbours."""

from __future__ import annotations

import numpy as np

_CELLS = 1 << 21


def _reach(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point's k-th nearest point, itself included: the narrowest of the k windows of k points around it."""
    n, at = len(x), np.arange(len(x))
    reach = np.full(n, np.inf)
    for back in range(k):
        first = at - back
        fits = np.flatnonzero((first >= 0) & (first + k <= n))
        first = first[fits]
        reach[fits] = np.minimum(reach[fits], np.maximum(x[fits] - x[first], x[first + k - 1] - x[fits]))
    return np.maximum(reach, 1e-12)


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 0.25, rounds: int = 3) -> np.ndarray:
    """Smoothed y at sorted x: local lines under tricube weights, bisquare weights of residuals after each round.

    Memory and time per round follow the points times their neighbours, some rows at a time.
    """
    n = len(x)
    h = _reach(x, max(2, min(n, int(round(frac * n)))))
    low, high = np.searchsorted(x, x - h, side="left"), np.searchsorted(x, x + h, side="right")
    width = int((high - low).max())
    step = max(1, _CELLS // width)
    robust, out = np.ones(n), y.astype(float)
    for _ in range(rounds + 1):
        for first in range(0, n, step):
            row = slice(first, min(first + step, n))
            at = low[row, None] + np.arange(width)
            inside = at < high[row, None]
            at = np.minimum(at, n - 1)
            xs, ys, own = x[at], y[at], x[row, None]
            near = np.where(inside, np.clip(1 - np.clip(np.abs(xs - own) / h[row, None], 0, 1) ** 3, 0, 1) ** 3, 0.0)
            w = near * robust[at]
            w = np.where(w.sum(axis=1, keepdims=True) > 1e-9, w, near)  # all neighbours discounted: none is
            s = np.maximum(w.sum(axis=1), 1e-300)
            mx, my = (w * xs).sum(axis=1) / s, (w * ys).sum(axis=1) / s
            dx = xs - mx[:, None]
            sxx, sxy = (w * dx**2).sum(axis=1), (w * dx * (ys - my[:, None])).sum(axis=1)
            out[row] = my + np.where(sxx > 1e-12, sxy / np.maximum(sxx, 1e-12), 0.0) * (x[row] - mx)
        r = y - out
        scale = np.median(np.abs(r))
        if scale <= 1e-12:
            break
        robust = np.clip(1 - (r / (6 * scale)) ** 2, 0, 1) ** 2
    return out
