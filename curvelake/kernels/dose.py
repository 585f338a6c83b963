"""Dose-response fits of one test: spline or four-parameter Hill curve, EC50, bootstrap."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from curvelake.kernels.growth import aic, stable_seed
from curvelake.kernels.lsq import fit_many
from curvelake.kernels.spline import packed, unique_mean


def hill(x, bottom, top, ec50, slope):
    return bottom + (top - bottom) / (1 + (np.maximum(x, 0) / ec50) ** slope)


def _hill_with_jacobian(x, p):
    bottom, top, ec50, slope = (p[:, i : i + 1] for i in range(4))
    with np.errstate(divide="ignore"):
        far = np.where(x > 0, np.log(np.maximum(x, 1e-300) / ec50), 0.0)
    share = np.where(x > 0, 1 / (1 + np.exp(np.clip(slope * far, -700, 700))), 1.0)
    change = -share * (1 - share) * (top - bottom)
    return bottom + (top - bottom) * share, np.stack([1 - share, share, change * (-slope / ec50), change * far], axis=2)


def _weighted_hill(t, p):
    value, jac = _hill_with_jacobian(t[..., 0], p)
    return t[..., 1] * value, t[..., 1:] * jac


def _by_dose(x: np.ndarray, y: np.ndarray) -> dict | None:
    """What least squares needs of a series: distinct doses, how often each stands, its mean response, the squares left within doses; start and bounds."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = np.asarray(x, float)[ok], np.asarray(y, float)[ok]
    if len(x) < 4:
        return None
    at, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse, weights=y) / times
    positive = x[x > 0]
    least, middle = (float(positive.min()), float(np.median(positive))) if len(positive) else (1e-6, max(1e-4, 0.5 * float(x.max())))
    lo, hi = float(y.min()), float(y.max())
    pad = max(1e-3, 0.2 * (hi - lo))
    return {
        "n": len(x), "at": at, "times": times, "mean": mean, "within": float(((y - mean[inverse]) ** 2).sum()), "starts": [[lo, hi, middle, 1.0], [hi, lo, middle, 1.0]],
        "lower": [lo - pad, lo - pad, max(1e-12, 1e-3 * least), 0.05], "upper": [hi + pad, hi + pad, max(1e-6, 1e3 * float(x.max()) + max(1e-3, float(np.ptp(x)))), 8.0],
    }


def fit_hill(x: np.ndarray, y: np.ndarray) -> dict:
    return fit_hills([(x, y)])[0]


_CELLS = 1 << 18  # doses times series fitted at once


def fit_hills(series: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """Least squares within bounds from a falling and a rising start, of many series at once.

    Points of one dose count as their mean, as often as they stand, which leaves sums of squares as they are; series are
    taken as they come and fitted in slices, so memory follows the points of one series and the slice, not all points.
    """
    out, held, most = [], [], 0
    for x, y in series:
        held.append(_by_dose(x, y))
        most = max(most, len(held[-1]["at"]) if held[-1] else 0)
        if most * len(held) >= _CELLS:
            out += _fit_held(held)
            held, most = [], 0
    return out + _fit_held(held)


def _fit_held(held: list[dict | None]) -> list[dict]:
    out: list[dict] = [{"success": False, "message": "insufficient_points"} for _ in held]
    able = [k for k, s in enumerate(held) if s]
    if not able:
        return out
    n = max(len(held[k]["at"]) for k in able) + 1
    t, y, use = np.zeros((2 * len(able), n, 2)), np.zeros((2 * len(able), n)), np.zeros((2 * len(able), n), dtype=bool)
    for row, s in enumerate(held[k] for k in able):
        both, m, root = slice(2 * row, 2 * row + 2), len(s["at"]), np.sqrt(s["times"])
        t[both, :m, 0], t[both, :m, 1], y[both, :m], use[both, : m + 1] = s["at"], root, root * s["mean"], True
        y[both, m] = np.sqrt(s["within"])  # a last point that no parameter moves
    starts = np.array([v for k in able for v in held[k]["starts"]])
    lower, upper = (np.repeat([held[k][c] for k in able], 2, axis=0) for c in ("lower", "upper"))
    p, rss, _ = fit_many(_weighted_hill, t, y, use, starts, lower, upper)
    rss = np.where(np.isfinite(rss), rss, np.inf).reshape(-1, 2)
    for row, k in enumerate(able):
        side = int(rss[row].argmin())
        best, left = p[2 * row + side], float(rss[row, side])
        if not np.isfinite(left):
            out[k] = {"success": False, "message": "fit_failed"}
            continue
        out[k] = {"success": True, "message": "", "method": "4pl", "status": "OK", "params": best, "ec50": float(best[2]), "rss": left, "aic": aic(left, held[k]["n"], 4), "y_ec50": float(hill(best[2], *best)), "bottom": float(best[0]), "top": float(best[1]), "monotonic": True}
    return out


def transform_x(x: np.ndarray, how: str) -> np.ndarray | None:
    """log: log10 with zeros at a tenth of the least positive dose; log1p; none."""
    if how == "log":
        positive = x[x > 0]
        return np.log10(np.where(x > 0, x, positive.min() / 10)) if len(positive) else None
    return np.log1p(x) if how == "log1p" else x


def back_x(x: float, how: str) -> float:
    return float(10**x if how == "log" else np.expm1(x) if how == "log1p" else x)


def pick_crossing(x: np.ndarray, y: np.ndarray, slope: np.ndarray) -> tuple[float, str]:
    """Where y meets the middle of its ends: the only crossing, the steepest of several, or the nearest point.

    Steepness is the curve's own slope; several crossings equally steep (to a hundredth) are AMBIGUOUS.
    """
    d = y - (y[0] + y[-1]) / 2
    touches, passes = np.flatnonzero(d == 0), np.flatnonzero(d[:-1] * d[1:] < 0)
    if not len(touches) + len(passes):
        return float(x[np.argmin(np.abs(d))]), "NO_CROSS_NEAREST"
    where = np.concatenate([x[touches], x[passes] + (x[passes + 1] - x[passes]) * d[passes] / (d[passes] - d[passes + 1])])
    if len(where) == 1:
        return float(where[0]), "OK"
    steep = np.interp(where, x, np.abs(slope))
    best = steep.max()
    if (np.abs(steep - best) <= max(1e-6, 0.01 * max(1.0, best))).sum() > 1:
        return float("nan"), "AMBIGUOUS"
    return float(where[steep.argmax()]), "MULTI_STEEPEST"


def fit_spline(x: np.ndarray, y: np.ndarray, x_log: str = "log", y_log: str = "none", lam: float | None = None, points: int = 2000, monotonic_only: bool = True) -> dict:
    """A smoothing spline over transformed doses; where it isn't monotonic, or is a line, the Hill curve stands in (method 4pl_fallback)."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, raw = np.asarray(x, float)[ok], np.asarray(y, float)[ok]
    if y_log == "log1p" and (raw < -1).any():
        return {"success": False, "message": "dr_y_transform_invalid_lt_minus1"}
    if y_log == "log" and (raw <= 0).any():
        return {"success": False, "message": "dr_y_transform_invalid_nonpositive"}
    tx = transform_x(x, x_log)
    if tx is None:
        return {"success": False, "message": "no_positive_concentration"}
    forward, back = {"log1p": (np.log1p, np.expm1), "log": (np.log10, lambda v: 10**v)}.get(y_log, (lambda v: v, lambda v: v))
    ux, uy = unique_mean(tx, forward(raw))
    if len(ux) < 5:
        return {"success": False, "message": "insufficient_points" if len(x) < 4 else "insufficient_unique_points", "n": len(ux)}
    systems, column = packed([(ux, uy)])
    lams, hows = systems.choose(column, lam, 3.5)
    f, m = systems.smooth(column, lams)
    grid, value, slope = (v[0] for v in systems.evaluate(f, m, points))
    slack = max(1e-8, 0.02 * float(slope.std()))
    monotonic = bool((slope >= -slack).all() or (slope <= slack).all())
    straight = bool(np.abs(slope).max() < 1.5 * max(float(np.abs(slope).mean()), 1e-8))
    if monotonic_only and (straight or not monotonic):
        other = fit_hill(*(unique_mean(tx, v)[1] for v in (x, raw)))
        return other | {"n": len(ux), "method": "4pl_fallback", "smoothing": "4pl"} if other["success"] else {"success": False, "message": "non_monotonic_no_fallback", "n": len(ux)}
    at, status = pick_crossing(grid, value, slope)
    rss = float(((uy - f[:, 0]) ** 2).sum())
    at_y = float(np.interp(at, grid, value)) if np.isfinite(at) else float("nan")
    return {
        "success": True, "message": {"AMBIGUOUS": "ambiguous_ec50"}.get(status, ""), "method": "spline", "status": status, "ec50": back_x(at, x_log), "y_ec50": float(back(at_y)), "rss": rss, "aic": aic(rss, len(ux), 4), "lam": float(lams[0]), "smoothing": hows[0],
        "df": float(systems.roughness(f, m)[0]), "n": len(ux), "monotonic": monotonic, "grid": grid, "curve": value,
    }


def fit_dose(x: np.ndarray, y: np.ndarray, x_log: str = "log", y_log: str = "none", method: str = "auto", lam: float | None = None, points: int = 2000) -> dict:
    """method: spline, 4pl, or auto (of the fits that succeed the one of lower AIC)."""
    model = fit_hill(x, y) if method in ("auto", "4pl") else {"success": False, "message": "not_run"}
    if method == "4pl":
        return model | {"n": len(np.unique(np.asarray(x)[np.isfinite(x) & np.isfinite(y)]))}
    spline = fit_spline(x, y, x_log, y_log, lam, points, monotonic_only=True) if method == "auto" else fit_spline(x, y, x_log, y_log, lam, points, monotonic_only=False)
    if model["success"] and (not spline["success"] or model["aic"] < spline["aic"]):
        return model | {"n": spline.get("n", 0), "spline_aic": spline.get("aic")}
    return spline | {"model_aic": model.get("aic")}


def bootstrap_dose(x: np.ndarray, y: np.ndarray, key: str, replicates: range, seed: int = 42, method: str = "auto", x_log: str = "log", y_log: str = "none", lam: float | None = None) -> list[float]:
    """EC50 of pair-resampled fits, each made afresh by the method that fits the data; replicates without a crossing don't count.

    Spline replicates keep the data's smoothing parameter; Hill replicates need four doses, and their EC50 must
    lie among the doses drawn.  Each replicate has its own generator, so any split of them over tasks draws the same.
    """
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = np.asarray(x, float)[ok], np.asarray(y, float)[ok]
    base = fit_dose(x, y, x_log, y_log, method, lam)
    if not base["success"] or len(x) < 6:
        return []
    if base["method"] == "spline":
        lam = base["lam"]
    picks = [np.random.default_rng([stable_seed(key, seed), k]).integers(0, len(x), len(x)) for k in replicates]
    drawn = [(x[p], np.maximum(y[p], 0)) for p in picks]
    if base["method"] == "spline":
        fits = [fit_spline(xs, ys, x_log, y_log, lam) for xs, ys in drawn]
        inside = [one["success"] and one["status"] != "NO_CROSS_NEAREST" for one in fits]
    else:
        fits = fit_hills([d if len(np.unique(d[0])) >= 4 else (d[0][:0], d[1][:0]) for d in drawn])
        inside = [one["success"] and xs.min() <= one["ec50"] <= xs.max() for one, (xs, _) in zip(fits, drawn, strict=True)]
    return [one["ec50"] for one, ok in zip(fits, inside, strict=True) if ok and np.isfinite(one["ec50"])]
