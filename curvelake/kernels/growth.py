"""Growth models and spline fits of one curve, with bootstraps, in numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from curvelake.kernels.lowess import lowess
from curvelake.kernels.lsq import fit_many
from curvelake.kernels.spline import Banded, packed, unique_mean


# The formulas of the four growth models, their bounds and start values.
# ``m`` is what computes: numpy here, Spark's functions in operators.fit.


def logistic(t, y0, a, mu, lam, m=np):
    a = max(a, 1e-12)
    return y0 + a / (1 + m.exp(m.clip(4 * mu / a * (lam - t) + 2, -50, 50)))


def gompertz(t, y0, a, mu, lam, m=np):
    a = max(a, 1e-12)
    return y0 + a * m.exp(-m.exp(m.clip(math.e * mu / a * (lam - t) + 1, -50, 50)))


def modified_gompertz(t, y0, a, mu, lam, alpha, shift, m=np):
    return gompertz(t, y0, a, mu, lam, m=m) + max(a, 1e-12) * m.exp(m.clip(alpha * (t - shift), -50, 50))


def richards(t, y0, a, mu, lam, nu, m=np):
    a, mu, nu = max(a, 1e-12), max(mu, 1e-12), min(max(nu, 1e-4), 50.0)
    x = m.clip(1 + nu + mu / a * (1 + nu) ** (1 + 1 / nu) * (lam - t), -50, 50)
    return y0 + a * (1 + nu * m.exp(x)) ** (-1 / nu)


def _sigmoid(value, top: float, shift: float):
    """Values and Jacobian of y0 + a * q(z), z = top * mu / a * (lam - t) + shift; value(z) gives q and dq/dz."""

    def model(t, p):
        y0, a, mu, lam = (p[:, i : i + 1] for i in range(4))
        a, d = np.maximum(a, 1e-12), lam - t
        z = top * mu / a * d + shift
        q, dq = value(np.clip(z, -50, 50))
        dq = np.where(np.abs(z) <= 50, dq, 0.0)
        return y0 + a * q, np.stack([np.ones_like(t), q - dq * (top * mu / a * d), dq * (top * d), dq * (top * mu) + 0 * t], axis=2)

    return model


def _logistic_part(z):
    q = 1 / (1 + np.exp(z))
    return q, -q * (1 - q)


def _gompertz_part(z):
    e = np.exp(z)
    q = np.exp(-e)
    return q, -e * q


_plain_gompertz = _sigmoid(_gompertz_part, math.e, 1.0)


def _late_rise(t, p):
    value, jac = _plain_gompertz(t, p)
    a, alpha, after = np.maximum(p[:, 1:2], 1e-12), p[:, 4:5], t - p[:, 5:6]
    z = alpha * after
    rise = np.exp(np.clip(z, -50, 50))
    free = np.where(np.abs(z) <= 50, a * rise, 0.0)
    jac[:, :, 1] += rise
    return value + a * rise, np.concatenate([jac, np.stack([free * after, -free * alpha], axis=2)], axis=2)


def _shaped(t, p):
    y0, a, mu, lam, nu = (p[:, i : i + 1] for i in range(5))
    a, mu, nu = np.maximum(a, 1e-12), np.maximum(mu, 1e-12), np.clip(nu, 1e-4, 50.0)
    d, c = lam - t, (1 + nu) ** (1 + 1 / nu)
    z = 1 + nu + mu / a * c * d
    e = np.exp(np.clip(z, -50, 50))
    b = 1 + nu * e
    q = b ** (-1 / nu)
    dq = np.where(np.abs(z) <= 50, -e * q / b, 0.0)
    dc = c * ((1 + 1 / nu) / (1 + nu) - np.log1p(nu) / nu**2)
    own = q * (np.log(b) / nu**2 - e / (nu * b))
    return y0 + a * q, np.stack([np.ones_like(t), q - dq * (mu / a * c * d), dq * (c * d), dq * (mu * c) + 0 * t, a * (own + dq * (1 + mu / a * d * dc))], axis=2)


#: Values and Jacobians of the models, a row of times and parameters per problem.
WITH_JACOBIAN = {"logistic": _sigmoid(_logistic_part, 4.0, 2.0), "gompertz": _plain_gompertz, "modified_gompertz": _late_rise, "richards": _shaped}

MODELS = {"logistic": logistic, "gompertz": gompertz, "modified_gompertz": modified_gompertz, "richards": richards}


def stable_seed(key: str, base: int = 42) -> int:
    return base + int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % 10_000


def aic(rss, n, k, m=np):
    return n * m.log(m.maximum(rss, 1e-12) / n) + 2 * k


def bic(rss, n, k, m=np):
    return n * m.log(m.maximum(rss, 1e-12) / n) + k * m.log(n)


def _starts(t, y):
    """Start values and bounds by name, from a smoothed curve."""
    s = lowess(t, y, 0.25) if len(t) >= 6 else y
    lo, hi = np.percentile(s, [5, 95])
    rng, top = max(float(np.ptp(y)), 1e-6), max(float(t.max()), 1e-6)
    ut, us = unique_mean(t, s)
    slope = float(np.max(np.gradient(us, ut))) if len(ut) > 2 else 0.5
    mu = float(np.clip(slope, 1e-6, 50))
    values = {"y0": lo, "a": max(hi - lo, 1e-6), "mu": mu, "lam": float(np.percentile(t, 20)), "alpha": float(np.clip(0.3 * mu, 1e-6, 10)), "shift": float(np.percentile(t, 75)), "nu": 1.0}
    bounds = {"y0": (y.min() - 2, y.max() + 2), "a": (0, 10 * rng), "mu": (1e-6, 50), "lam": (-3 * top, 1.5 * top), "alpha": (1e-6, 10), "shift": (0, 1.5 * top), "nu": (1e-4, 20)}
    return values, bounds, rng, top


NAMES = {"logistic": ["y0", "a", "mu", "lam"], "gompertz": ["y0", "a", "mu", "lam"], "modified_gompertz": ["y0", "a", "mu", "lam", "alpha", "shift"], "richards": ["y0", "a", "mu", "lam", "nu"]}


def _seeds(name: str, values: dict[str, float], y: np.ndarray, top: float) -> list[dict[str, float]]:
    """The start itself; earlier lags where growth is inhibited; each of these with three shapes for richards."""
    peak = float(y.max())
    lags = [values["lam"]]
    if (peak > 1e-10 and float(np.ptp(y)) / peak < 0.15) or values["lam"] >= 0.8 * top:
        lags += [-top, -top / 2, -top / 4]
    shapes = [values["nu"], 0.5, 2.0] if name == "richards" else [values["nu"]]
    return [values | {"lam": lag, "nu": nu} for nu in shapes for lag in lags]


def _degenerate(p: np.ndarray, se: np.ndarray) -> np.ndarray:
    """Per row: parameters without a value or an error, or known by less than a fifth; a baseline is measured by the amplitude."""
    size = np.abs(p)
    size[:, 0] = np.maximum(size[:, 0], size[:, 1])
    known = np.isfinite(p).all(1) & np.isfinite(se).all(1)
    with np.errstate(invalid="ignore"):
        return ~known | (se < 1e-8).any(1) | ((se > 5 * size) & (size > 1e-12)).any(1)


_CELLS = 1 << 20  # points times parameters of problems solved at once


def fit_models(t: np.ndarray, y: np.ndarray, points: int = 400) -> dict:
    return fit_models_many([(t, y)], points)[0]


def fit_models_many(curves: list[tuple[np.ndarray, np.ndarray]], points: int = 400) -> list[dict]:
    """Of each curve the model of lowest AIC among those that fit inside their bounds, with a status per model.

    All curves and starts of a model are solved in one batch.  Where every model that could be fitted ends at a bound, the
    best of these stands, with the message at_bounds.
    """
    clean = []
    for t, y in curves:
        t, y = np.asarray(t, float), np.asarray(y, float)
        ok = np.isfinite(t) & np.isfinite(y)
        order = np.argsort(t[ok], kind="stable")
        clean.append((t[ok][order], y[ok][order]))
    begun = [_starts(t, y) if len(t) >= 4 else None for t, y in clean]
    tables: list[list] = [[] for _ in clean]
    fits: list[list[dict]] = [[] for _ in clean]
    for name, names in NAMES.items():
        k = len(names)
        problems = []
        for i, (t, y) in enumerate(clean):
            if begun[i] is not None and len(t) >= k + 2:
                values, bounds, _, top = begun[i]
                lower, upper = np.array([bounds[x] for x in names], float).T
                problems += [(i, np.array([s[x] for x in names]), lower, upper) for s in _seeds(name, values, y, top)]
            elif begun[i] is not None:
                tables[i].append((name, "insufficient_points", None))
        solved: dict[int, tuple] = {}
        for part in _parts(problems, clean, k):
            n = max(len(clean[i][0]) for i, *_ in part)
            t, y, use = np.zeros((len(part), n)), np.zeros((len(part), n)), np.zeros((len(part), n), dtype=bool)
            for row, (i, *_) in enumerate(part):
                m = len(clean[i][0])
                t[row, :m], y[row, :m], use[row, :m] = *clean[i], True
            start, lower, upper = (np.array([x[c] for x in part]) for c in (1, 2, 3))
            p, rss, cov = fit_many(WITH_JACOBIAN[name], t, y, use, start, lower, upper)
            se = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0))
            bad = _degenerate(p, se) | ~np.isfinite(rss)
            bound = np.minimum(np.abs(p - lower), np.abs(p - upper)).min(axis=1) <= 1e-5
            for row, (i, *_) in enumerate(part):
                if not bad[row] and (i not in solved or rss[row] < solved[i][1]):
                    solved[i] = (p[row], float(rss[row]), se[row], bool(bound[row]))
                else:
                    solved.setdefault(i, (None, np.inf, None, False))
        for i, (p, rss, se, bound) in solved.items():
            n = len(clean[i][0])
            if p is None:
                tables[i].append((name, "exception", None))
                continue
            tables[i].append((name, "bounds" if bound else "ok", aic(rss, n, k)))
            fits[i].append({"model": name, "params": p, "se": se, "rss": rss, "aic": aic(rss, n, k), "bic": bic(rss, n, k), "bound": bound})
    return [_chosen(t, y, table, found, points) for (t, y), table, found in zip(clean, tables, fits, strict=True)]


def _parts(problems: list[tuple], clean: list, k: int):
    """Problems in batches of bounded size, curves of like length together."""
    part, widest = [], 0
    for p in sorted(problems, key=lambda x: len(clean[x[0]][0])):
        widest = len(clean[p[0]][0])
        if part and (len(part) + 1) * widest * k > _CELLS:
            yield part
            part = []
        part.append(p)
    if part:
        yield part


def _chosen(t: np.ndarray, y: np.ndarray, table: list, found: list[dict], points: int) -> dict:
    n = len(t)
    if n < 4:
        return {"success": False, "message": "insufficient_points", "aic_table": [], "n": n}
    inside = [f for f in found if not f["bound"]]
    if not found:
        return {"success": False, "message": "all_models_failed", "aic_table": table, "n": n}
    best = min(inside or found, key=lambda f: f["aic"])
    named = dict(zip(NAMES[best["model"]], best["params"], strict=True))
    errors = dict(zip(NAMES[best["model"]], best["se"], strict=True))
    grid = np.linspace(t.min(), t.max(), points)
    curve = MODELS[best["model"]](grid, *best["params"])
    second = min((f["aic"] for f in inside or found if f is not best), default=None)
    derived = {"mu": named["mu"], "lag": named["lam"], "a": max(named["a"], 0.0), "mu_se": errors["mu"], "lag_se": errors["lam"], "a_se": errors["a"]}
    return best | derived | {"success": True, "message": "" if inside else "at_bounds", "n": n, "integral": float(np.trapezoid(curve, grid)), "aic_table": table, "second_aic": second, "grid": grid, "curve": curve}


def summary_of(grid: np.ndarray, value: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, ...]:
    """mu, lag (tangent), A, integral; one row per curve."""
    k = slope.argmax(axis=1)
    row = np.arange(len(value))
    mu = slope[row, k]
    with np.errstate(divide="ignore", invalid="ignore"):
        lag = np.where(mu > 1e-12, grid[row, k] - (value[row, k] - value[:, 0]) / mu, np.nan)
    return mu, lag, value.max(axis=1) - value[:, 0], np.trapezoid(value, grid, axis=1)


def fit_spline(t: np.ndarray, y: np.ndarray, lam: float | None = None, points: int = 400) -> dict:
    return fit_splines([(t, y)], lam, points)[0]


def fit_splines(curves: list[tuple[np.ndarray, np.ndarray]], lam: float | None = None, points: int = 400) -> list[dict]:
    """Curves of like length share their sweeps."""
    clean = [unique_mean(np.asarray(t, float), np.asarray(y, float)) for t, y in curves]
    out: list[dict] = [{"success": False, "message": "insufficient_points" if not len(t) else "insufficient_unique_points", "n": len(t)} for t, _ in clean]
    able = sorted((k for k, (t, _) in enumerate(clean) if len(t) >= 4), key=lambda k: len(clean[k][0]))
    for first in range(0, len(able), 64):
        part = able[first : first + 64]
        systems, y = packed([clean[k] for k in part])
        lams, how = systems.choose(y, lam)
        f, m = systems.smooth(y, lams)
        df, (grid, value, slope) = systems.roughness(f, m), systems.evaluate(f, m, points)
        mu, lag, a, integral = summary_of(grid, value, slope)
        for i, k in enumerate(part):
            n = len(clean[k][0])
            out[k] = {
                "success": True, "message": "", "n": n, "lam": float(lams[i]), "smoothing": how[i], "df": float(df[i]), "rss": float(((y[:n, i] - f[:n, i]) ** 2).sum()), "mu": float(mu[i]), "lag": float(lag[i]), "a": float(a[i]),
                "integral": float(integral[i]), "grid": grid[i], "curve": value[i], "slope": slope[i], "fitted": f[:n, i], "t": clean[k][0], "y": clean[k][1],
            }
    return out


def bootstrap_spline(t: np.ndarray, y: np.ndarray, key: str, replicates: int = 200, method: str = "pairs", seed: int = 42, points: int = 400, base: dict | None = None) -> dict[str, np.ndarray]:
    """mu, lag, a, integral of each replicate; the smoothing parameter stays that of the data (``base``: its fit, if made).

    pairs: a fit per draw of points, of which repeated ones are one point of the same mean.  residual: a fit per draw of
    residuals.  All replicates are banded systems side by side.
    """
    base = fit_spline(t, y, points=points) if base is None else base
    if not base["success"] or base["n"] < 6:
        return {}
    rng = np.random.default_rng(stable_seed(key, seed))
    x, y, n = base["t"], base["y"], base["n"]
    if method == "residual":
        r = y - base["fitted"]
        drawn = (base["fitted"] + rng.choice(r - r.mean(), size=(replicates, n))).T
        systems = Banded(np.repeat(x[:, None], replicates, axis=1), np.full(replicates, n))
    else:
        held = np.zeros((replicates, n), dtype=bool)
        held[np.arange(replicates)[:, None], rng.integers(0, n, (replicates, n))] = True
        held = held[held.sum(1) >= 4]
        if not len(held):
            return {}
        at = np.argsort(~held, axis=1, kind="stable").T
        systems, drawn = Banded(x[at], held.sum(1)), y[at]
    f, m = systems.smooth(drawn, np.full(drawn.shape[1], base["lam"]))
    grid, value, slope = systems.evaluate(f, m, points)
    mu, lag, a, integral = summary_of(grid, value, slope)
    return {"mu": mu, "lag": lag, "a": a, "integral": integral, "curves": value if method == "residual" else None, "grid": base["grid"]}


PARAMETERS = ("mu", "lag", "a", "integral")


def bootstrap_summary(draws: dict[str, np.ndarray], alpha: float = 0.05) -> dict[str, tuple]:
    """Per parameter: number of finite draws, mean, deviation, the interval of 1 - alpha and that of 90 %."""
    out = {}
    for name in PARAMETERS:
        v = draws[name][np.isfinite(draws[name])] if draws else np.zeros(0)
        if len(v):
            q = np.quantile(v, [alpha / 2, 1 - alpha / 2, 0.05, 0.95])
            out[name] = (len(v), float(v.mean()), float(v.std(ddof=1)) if len(v) > 1 else 0.0, *map(float, q))
    return out
