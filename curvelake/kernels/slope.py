"""Median slope over all pairs of points, exactly, without looking at all pairs.

A pair's slope is at most m just if its later point doesn't lie above the earlier one once m * t is taken off, so
the slopes up to m are counted as inversions of a sequence, by merging (Matousek, 1991).  Slopes of random pairs
close the median in until few pairs lie between two bounds; these are the inversions between the orders under both
bounds, and only they are listed.
"""

from __future__ import annotations

import numpy as np

_LISTED = 1 << 20


def _inversions(rank: np.ndarray, listed: bool = False) -> tuple[int, list[np.ndarray]]:
    """Pairs of places i < j with rank[j] < rank[i]: their number, and (i, j) of all if asked for."""
    n = len(rank)
    size = 1 << max(1, (n - 1).bit_length())
    keys = np.concatenate([rank, np.arange(n, size)])  # what is filled up lies above all, in order
    place = np.arange(size)
    count, pairs, width = 0, [], 1
    while width < size:
        blocks = size // (2 * width)
        left, right = (keys.reshape(blocks, 2, width)[:, k] for k in (0, 1))
        base = (np.arange(blocks) * size)[:, None]
        ahead = np.searchsorted((left + base).ravel(), (right + base).ravel()).reshape(blocks, width) - np.arange(blocks)[:, None] * width
        above = width - ahead
        count += int(above.sum())
        if listed and above.any():
            left_place = place.reshape(blocks, 2, width)[:, 0].ravel()
            times, b, r = above.ravel(), *np.divmod(np.flatnonzero(np.ones(above.size, dtype=bool)), width)
            some = np.flatnonzero(times)
            times, b, r = times[some], b[some], r[some]
            first = np.repeat(b * width + (width - times) - (np.cumsum(times) - times), times)
            pairs.append(np.stack([left_place[first + np.arange(int(times.sum()))], np.repeat(place.reshape(blocks, 2, width)[b, 1, r], times)]))
        order = np.argsort(keys.reshape(blocks, 2 * width), axis=1, kind="stable")
        keys, place = (np.take_along_axis(a.reshape(blocks, 2 * width), order, axis=1).ravel() for a in (keys, place))
        width *= 2
    return count, pairs


def _order(t: np.ndarray, y: np.ndarray, m: float) -> np.ndarray:
    """Ranks of y - m * t; of equal ones the later point is the lower."""
    rank = np.empty(len(t), dtype=np.int64)
    rank[np.lexsort((-np.arange(len(t)), y - m * t))] = np.arange(len(t))
    return rank


def median_slope(t: np.ndarray, y: np.ndarray, most: int = _LISTED) -> float | None:
    """None without a pair of different times.  At most about ``most`` slopes are held at once."""
    order = np.lexsort((y, t))
    t, y = np.asarray(t, float)[order], np.asarray(y, float)[order]
    n = len(t)
    same_t = np.unique(t, return_counts=True)[1]
    total = n * (n - 1) // 2 - int((same_t * (same_t - 1) // 2).sum())
    if not total:
        return None
    want = np.array([(total - 1) // 2, total // 2])
    if n * (n - 1) // 2 <= most:
        i, j = np.triu_indices(n, 1)
        later = t[j] > t[i]
        return float(np.sort((y[j] - y[i])[later] / (t[j] - t[i])[later])[want].mean())
    equal = np.unique(np.stack([t, y]), axis=1, return_counts=True)[1]
    always = int((equal * (equal - 1) // 2).sum())  # equal points count under every slope
    rng = np.random.default_rng(n)
    below, upto = 0, total
    low, high = -np.inf, np.inf
    while upto - below > most:
        i, j = np.sort(rng.integers(0, n, (2, 8 * n)), axis=0)
        later = t[j] > t[i]
        s = (y[j] - y[i])[later] / (t[j] - t[i])[later]
        s = np.sort(s[(s > low) & (s < high)])
        if len(s) < 64:
            break
        share = (want - below) / (upto - below)
        slack = 3 / np.sqrt(len(s))
        moved = False
        for side, q in (("low", share[0] - slack), ("high", share[1] + slack)):
            m = float(s[int(np.clip(q * len(s), 0, len(s) - 1))])
            if not low < m < high:
                continue
            reached = _inversions(_order(t, y, m))[0] - always
            if side == "low" and reached <= want[0]:
                low, below, moved = m, reached, True
            elif side == "high" and reached > want[1]:
                high, upto, moved = m, reached, True
        if not moved:
            break
    if upto - below > max(most, 8 * n):  # one slope holds most pairs
        return _by_values(t, y, low, high, below, upto, want, always)
    under = _order(t, y, low) if np.isfinite(low) else np.arange(n)
    over = _order(t, y, high) if np.isfinite(high) else np.arange(n)[::-1]
    at = np.argsort(under)
    pairs = np.concatenate(_inversions(over[at], listed=True)[1] or [np.zeros((2, 0), dtype=np.int64)], axis=1)
    i, j = np.sort(at[pairs], axis=0)
    later = t[j] > t[i]
    s = np.sort((y[j] - y[i])[later] / (t[j] - t[i])[later])
    return float(s[want - below].mean())


def _by_values(t: np.ndarray, y: np.ndarray, low: float, high: float, below: int, upto: int, want: np.ndarray, always: int) -> float:
    """Bisection on the slope itself, for the middle ranks one by one; ends at the slope that so many pairs share."""
    found = []
    for rank in want:
        a = low if np.isfinite(low) else -np.abs(np.diff(y)).max() / max(np.diff(np.unique(t)).min(), 1e-300)
        b = high if np.isfinite(high) else np.abs(np.ptp(y)) / max(np.diff(np.unique(t)).min(), 1e-300)
        for _ in range(200):
            mid = a + (b - a) / 2
            if not a < mid < b:
                break
            if _inversions(_order(t, y, mid))[0] - always > rank:
                b = mid
            else:
                a = mid
        found.append(b)
    return float(np.mean(found))
