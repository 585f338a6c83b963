"""Natural cubic smoothing splines with generalised cross-validation: banded systems, many of them at once.

Minimises sum (y - f)^2 + lam * integral of f''^2.  The second derivatives g at the inner points solve the
pentadiagonal system (R + lam Q'Q) g = Q'y, and y - f = lam Q g (Reinsch, 1967).  A ``Banded`` holds such systems
for any number of curves, draws or smoothing parameters side by side and factors them in one sweep over the points,
so time and memory grow with the points alone; the trace that cross-validation needs comes from the bands of the
inverse (Hutchinson and de Hoog, 1985).
"""

from __future__ import annotations

import numpy as np

#: Smoothing parameters looked at, and rounds of bisection.
LOG_LEAST, LOG_MOST, GRID, FINE, ROUNDS = -12.0, 6.0, 181, 41, 30
_CELLS = 1 << 20  # points times systems factored at once


def unique_mean(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct finite x in order, and the mean y at each."""
    ok = np.isfinite(x) & np.isfinite(y)
    ux, inverse = np.unique(x[ok], return_inverse=True)
    return ux, np.bincount(inverse, weights=y[ok]) / np.maximum(np.bincount(inverse), 1)


class Banded:
    """Systems of curves: x and size (points in use); arrays have a row per point and a column per curve."""

    def __init__(self, x: np.ndarray, size: np.ndarray):
        n, m = x.shape
        self.size, self.point = size, np.arange(n)[:, None]
        self.x = np.where(self.point < size, x, 0.0)
        h = np.where(self.point[:-1] < size - 1, np.diff(self.x, axis=0), 1.0)
        inner = self.point[: n - 2] < size - 2
        self.h = h
        first, last = 1 / h[:-1], 1 / h[1:]
        self.q = np.stack([np.where(inner, v, 0.0) for v in (first, -first - last, last)])
        self.inner = inner
        second, third = inner[1:], inner[2:]
        self.r0 = np.where(inner, (h[:-1] + h[1:]) / 3, 1.0)
        self.r1 = np.where(second, h[1:-1] / 6, 0.0)
        q0, q1, q2 = self.q
        self.k0 = q0**2 + q1**2 + q2**2
        self.k1 = np.where(second, q1[:-1] * q0[1:] + q2[:-1] * q1[1:], 0.0)
        self.k2 = np.where(third, q2[:-2] * q0[2:], 0.0)

    def take(self, columns: np.ndarray) -> Banded:
        """The systems of some columns, any number of times each."""
        out = object.__new__(Banded)
        out.size, out.point, out.x, out.h = self.size[columns], self.point, self.x[:, columns], self.h[:, columns]
        out.q, out.inner = self.q[:, :, columns], self.inner[:, columns]
        for name in ("r0", "r1", "k0", "k1", "k2"):
            setattr(out, name, getattr(self, name)[:, columns])
        return out

    def factor(self, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """D and both bands of L in L D L' = R + lam Q'Q."""
        a, b, c = self.r0 + lam * self.k0, self.r1 + lam * self.k1, lam * self.k2
        n = len(a)
        d, one, two = a.copy(), np.zeros_like(a), np.zeros_like(a)
        for i in range(n):
            if i:
                d[i] -= one[i - 1] ** 2 * d[i - 1]
            if i > 1:
                d[i] -= two[i - 2] ** 2 * d[i - 2]
            if i < n - 1:
                one[i] = (b[i] - (two[i - 1] * one[i - 1] * d[i - 1] if i else 0.0)) / d[i]
            if i < n - 2:
                two[i] = c[i] / d[i]
        return d, one, two

    def bends(self, y: np.ndarray, factors: tuple) -> np.ndarray:
        """Second derivatives at the inner points."""
        d, one, two = factors
        q0, q1, q2 = self.q
        z = q0 * y[:-2] + q1 * y[1:-1] + q2 * y[2:]
        n = len(z)
        for i in range(1, n):
            z[i] -= one[i - 1] * z[i - 1]
            if i > 1:
                z[i] -= two[i - 2] * z[i - 2]
        z /= d
        for i in range(n - 2, -1, -1):
            z[i] -= one[i] * z[i + 1]
            if i < n - 2:
                z[i] -= two[i] * z[i + 2]
        return z

    def residual(self, bends: np.ndarray, lam: np.ndarray) -> np.ndarray:
        out = np.zeros_like(self.x)
        for k in range(3):
            out[k : len(out) - 2 + k] += self.q[k] * bends
        return lam * out

    def smooth(self, y: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fitted values and second derivatives at all points."""
        y = np.where(self.point < self.size, y, 0.0)
        bends = self.bends(y, self.factor(lam))
        m = np.zeros_like(y)
        m[1:-1] = bends
        return y - self.residual(bends, lam), m

    def freedom_lost(self, lam: np.ndarray, factors: tuple) -> np.ndarray:
        """n minus the trace of the smoother: lam times the trace of (R + lam Q'Q)^-1 Q'Q."""
        d, one, two = factors
        n = len(d)
        s0, s1, s2 = np.zeros((3, *d[0].shape)), np.zeros((3, *d[0].shape)), np.zeros((3, *d[0].shape))  # three rows of the inverse's bands, in turn
        total = np.zeros(d.shape[1])
        for i in range(n - 1, -1, -1):
            a, b, now = (i + 1) % 3, (i + 2) % 3, i % 3
            s1[now] = -one[i] * s0[a] - two[i] * s1[a]
            s2[now] = -one[i] * s1[a] - two[i] * s0[b]
            s0[now] = 1 / d[i] - one[i] * s1[now] - two[i] * s2[now]
            total += s0[now] * self.k0[i]
            if i < n - 1:
                total += 2 * s1[now] * self.k1[i]
            if i < n - 2:
                total += 2 * s2[now] * self.k2[i]
        return lam * total

    def gcv(self, y: np.ndarray, lam: np.ndarray) -> np.ndarray:
        factors = self.factor(lam)
        y = np.where(self.point < self.size, y, 0.0)
        rest = self.residual(self.bends(y, factors), lam)
        return self.size * (rest**2).sum(axis=0) / np.maximum(self.freedom_lost(lam, factors), 1e-300) ** 2

    def slopes(self, f: np.ndarray, m: np.ndarray) -> np.ndarray:
        """First derivatives at the points in use, 0 beyond."""
        rise, h = np.diff(f, axis=0) / self.h, self.h
        out = np.zeros_like(f)
        out[:-1] = rise - (2 * m[:-1] + m[1:]) * h / 6
        last = (self.size - 1, np.arange(f.shape[1]))
        before = (self.size - 2, np.arange(f.shape[1]))
        out[last] = (rise + (m[:-1] + 2 * m[1:]) * h / 6)[before]
        return np.where(self.point < self.size, out, 0.0)

    def roughness(self, f: np.ndarray, m: np.ndarray) -> np.ndarray:
        """2 + ln(1 + n * sum f''^2 / sum f'^2) at the data, between 2 (a line) and n."""
        steep, bend = (self.slopes(f, m) ** 2).sum(0), (m**2).sum(0)
        value = 2 + np.log1p(self.size * bend / np.maximum(steep, 1e-300))
        return np.where(steep < 1e-20, 2.0, np.clip(value, 2, self.size))

    def evaluate(self, f: np.ndarray, m: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each curve's own even grid over its range, values and slopes there; a row per curve."""
        column = np.arange(f.shape[1])
        first, last = self.x[0], self.x[self.size - 1, column]
        at = np.linspace(first, last, points, axis=1)
        # one search over all curves: positions within each range, shifted by the curve's number
        spread = np.maximum(last - first, 1e-300)
        keys = np.where(self.point < self.size, (self.x - first) / spread, 1.0) + 2 * column
        i = np.searchsorted(keys.T.ravel(), ((at - first[:, None]) / spread[:, None] + 2 * column[:, None]).ravel(), side="right").reshape(at.shape) - 1 - column[:, None] * len(f)
        i = np.clip(i, 0, self.size[:, None] - 2)
        c = column[:, None]
        h = self.h[i, c]
        a, b = (self.x[i + 1, c] - at) / h, (at - self.x[i, c]) / h
        f0, f1, m0, m1 = f[i, c], f[i + 1, c], m[i, c], m[i + 1, c]
        value = a * f0 + b * f1 + ((a**3 - a) * m0 + (b**3 - b) * m1) * h**2 / 6
        slope = (f1 - f0) / h + ((1 - 3 * a**2) * m0 + (3 * b**2 - 1) * m1) * h / 6
        return at, value, slope

    # smoothing parameters

    def _lowest(self, y: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Per curve (column) the index of the log parameter (row of logs) of least GCV."""
        count = len(logs)
        best = np.empty(logs.shape[1], dtype=int)
        step = max(1, _CELLS // (len(self.x) * count))
        for k in range(0, logs.shape[1], step):
            mine = np.arange(k, min(k + step, logs.shape[1]))
            parts = max(1, _CELLS // (len(self.x) * len(mine)))
            scores = [self.take(np.repeat(mine, len(logs[r : r + parts]))).gcv(np.repeat(y[:, mine], len(logs[r : r + parts]), axis=1), 10 ** logs[r : r + parts, mine].T.ravel()).reshape(len(mine), -1) for r in range(0, count, parts)]
            best[mine] = np.argmin(np.concatenate(scores, axis=1), axis=1)
        return best

    def best_gcv(self, y: np.ndarray) -> np.ndarray:
        coarse = np.linspace(LOG_LEAST, LOG_MOST, GRID)
        k = self._lowest(y, np.repeat(coarse[:, None], y.shape[1], axis=1))
        fine = np.linspace(coarse[np.maximum(k - 1, 0)], coarse[np.minimum(k + 1, GRID - 1)], FINE)
        return 10 ** fine[self._lowest(y, fine), np.arange(y.shape[1])]

    def lam_for_df(self, y: np.ndarray, least: float) -> np.ndarray:
        """The smoothest parameter that keeps a roughness of ``least``: bisection in log space, all curves at once."""
        lo, hi = np.full(y.shape[1], LOG_LEAST), np.full(y.shape[1], LOG_MOST)
        out_of_reach = self.roughness(*self.smooth(y, 10**lo)) < least
        for _ in range(ROUNDS):
            mid = (lo + hi) / 2
            enough = self.roughness(*self.smooth(y, 10**mid)) >= least
            lo, hi = np.where(enough, mid, lo), np.where(enough, hi, mid)
        return 10 ** np.where(out_of_reach, LOG_LEAST, (lo + hi) / 2)

    def choose(self, y: np.ndarray, lam: float | None = None, least_df: float = 4.0) -> tuple[np.ndarray, list[str]]:
        """A given parameter, else GCV's if the fit is rough enough, else the one that is just so."""
        if lam is not None and np.isfinite(lam):
            return np.full(y.shape[1], float(lam)), ["user"] * y.shape[1]
        best = self.best_gcv(y)
        how = np.array(["gcv_ok"] * y.shape[1], dtype=object)
        short = np.flatnonzero(~(self.roughness(*self.smooth(y, best)) >= least_df))
        if len(short):
            part = self.take(short)
            best[short] = part.lam_for_df(y[:, short], least_df)
            reached = part.roughness(*part.smooth(y[:, short], best[short])) >= least_df - 1e-6
            how[short] = np.where(reached, "gcv_bounded_floor", "gcv_bounded_unreachable")
        return best, how.tolist()


def packed(curves: list[tuple[np.ndarray, np.ndarray]]) -> tuple[Banded, np.ndarray]:
    """Systems of curves (distinct sorted x, three points or more) and their y."""
    size = np.array([len(x) for x, _ in curves])
    x, y = np.zeros((size.max(), len(curves))), np.zeros((size.max(), len(curves)))
    for k, (a, b) in enumerate(curves):
        x[: len(a), k], y[: len(a), k] = a, b
    return Banded(x, size), y
