"""Bounded non-linear least squares for many problems at once: a reflective trust region with analytic Jacobians.

All problems of a batch take their steps together in three-dimensional arrays (problem, point, parameter); those
that have converged leave the batch.  Distances to the bounds scale the parameters (Coleman and Li, 1996), so steps
shorten towards a bound instead of sticking to it; a step that would leave the box is either cut short or reflected
at the bound it meets first, whichever the quadratic model likes better.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_TINY = 1e-300


def _model_value(gradient: np.ndarray, hessian: np.ndarray, step: np.ndarray) -> np.ndarray:
    return (gradient * step).sum(1) + 0.5 * np.einsum("mk,mkl,ml->m", step, hessian, step)


def _inside(p: np.ndarray, step: np.ndarray, lower: np.ndarray, upper: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """The step itself, or the better of the cut and the reflected one."""
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(step > 0, (upper - p) / step, np.where(step < 0, (lower - p) / step, np.inf))
    first = np.maximum(room.min(axis=1), 0.0)
    leaves = first <= 1
    if not leaves.any():
        return step
    cut = step * np.where(leaves, 0.995 * first, 1.0)[:, None]
    turned = np.where((room == room.min(axis=1, keepdims=True)) & leaves[:, None], -step, step)
    met = p + step * np.minimum(first, 1.0)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        more = np.where(turned > 0, (upper - met) / turned, np.where(turned < 0, (lower - met) / turned, np.inf))
    rest = np.minimum(np.maximum(1 - first, 0.0), 0.995 * np.maximum(more.min(axis=1), 0.0))
    bounced = met - p + turned * rest[:, None]
    better = leaves & (_model_value(gradient, hessian, bounced) < _model_value(gradient, hessian, cut))
    return np.where(better[:, None], bounced, cut)


def fit_many(model: Callable, t: np.ndarray, y: np.ndarray, use: np.ndarray, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 400, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, rss, covariance) of each problem.

    model(t, p) gives values (problem, point) and Jacobian (problem, point, parameter); ``use`` marks the points
    that a problem has.  The covariance is the pseudo-inverse of J'J times rss / degrees of freedom.
    """
    start, lower, upper = (np.broadcast_to(np.asarray(a, float), (len(t), np.shape(start)[-1])) for a in (start, lower, upper))
    edge = np.minimum(1e-9, 1e-3 * (upper - lower))
    p = np.clip(start, lower + edge, upper - edge)
    value, jac = model(t, p)
    value, jac = np.where(use, value, 0.0), np.where(use[..., None], jac, 0.0)
    left = np.where(use, y, 0.0) - value
    rss, damp = (left**2).sum(1), np.full(len(t), 1e-3)
    live = np.flatnonzero(np.isfinite(rss) & np.isfinite(jac).all(axis=(1, 2)))
    for _ in range(rounds):
        if not len(live):
            break
        q, j, lo, hi = p[live], jac[live], lower[live], upper[live]
        g = -np.einsum("mnk,mn->mk", j, left[live])
        room = np.where(g < 0, hi - q, q - lo)
        scale = np.sqrt(np.maximum(room, 1e-14))
        full = np.einsum("mnk,mnl->mkl", j, j)
        scaled = full * scale[:, :, None] * scale[:, None, :]
        at = np.arange(q.shape[1])
        scaled[:, at, at] += np.abs(g)
        weight = np.maximum(scaled[:, at, at], 1e-12 * scaled[:, at, at].max(axis=1, keepdims=True) + _TINY)
        scaled[:, at, at] += damp[live][:, None] * weight
        step = scale * np.linalg.solve(scaled, -(scale * g)[..., None])[..., 0]
        step = _inside(q, step, lo, hi, g, full)
        new = np.clip(q + step, lo, hi)
        v, j2 = model(t[live], new)
        v, j2 = np.where(use[live], v, 0.0), np.where(use[live][..., None], j2, 0.0)
        r = np.where(use[live], y[live], 0.0) - v
        gained = rss[live] - (r**2).sum(1)
        ok = (gained > 0) & np.isfinite(gained) & np.isfinite(j2).all(axis=(1, 2))
        hoped = -2 * _model_value(g, full, new - q)
        ratio = gained / np.maximum(hoped, _TINY)
        small = np.abs(new - q).max(axis=1) <= tol * (tol + np.abs(q).max(axis=1))
        done = (ok & (gained <= tol * rss[live]) & (ratio > 0.25)) | small | (np.abs(room * g).max(axis=1) < 1e-14) | (damp[live] > 1e14)
        moved = live[ok]
        p[moved], jac[moved], left[moved] = new[ok], j2[ok], r[ok]
        rss[moved] -= gained[ok]
        damp[live] = np.where(ok, np.maximum(damp[live] * np.where(ratio > 0.75, 0.2, np.where(ratio > 0.25, 0.5, 2.0)), 1e-12), damp[live] * 4)
        live = live[~done]
    rss = (left**2).sum(1)
    spread = np.full((len(t), p.shape[1], p.shape[1]), np.nan)
    fine = np.flatnonzero(np.isfinite(rss) & np.isfinite(jac).all(axis=(1, 2)))
    if len(fine):
        _, s, vt = np.linalg.svd(jac[fine], full_matrices=False)
        kept = s > np.finfo(float).eps * max(jac.shape[1:]) * s[:, :1]
        inverse = np.where(kept, 1 / np.where(kept, s, 1.0) ** 2, 0.0)
        free = np.maximum(use[fine].sum(1) - p.shape[1], 1)
        spread[fine] = np.einsum("mki,mk,mkj->mij", vt, inverse, vt) * (rss[fine] / free)[:, None, None]
    return p, rss, spread


def fit(model: Callable, x: np.ndarray, y: np.ndarray, start, lower, upper, rounds: int = 400) -> tuple[np.ndarray, float, np.ndarray]:
    """One problem whose model(x, *parameters) has no Jacobian of its own: central differences stand in."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    lower, upper = np.asarray(lower, float), np.asarray(upper, float)

    def numeric(_, p):
        jac = np.empty((1, len(x), p.shape[1]))
        for k in range(p.shape[1]):
            h = 1e-6 * max(abs(p[0, k]), 1e-3)
            up, down = p[0].copy(), p[0].copy()
            up[k], down[k] = min(up[k] + h, upper[k]), max(down[k] - h, lower[k])
            jac[0, :, k] = (model(x, *up) - model(x, *down)) / max(up[k] - down[k], _TINY)
        return model(x, *p[0])[None], jac

    p, rss, spread = fit_many(numeric, x[None], y[None], np.ones((1, len(x)), dtype=bool), np.asarray(start, float)[None], lower, upper, rounds)
    return p[0], float(rss[0]), spread[0]
