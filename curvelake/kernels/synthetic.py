"""Labelled synthetic curves, many at once: kinds of curves are rows of data that one set of array steps reads.

A kind says how its curves rise (families of growth models, a sum of waves, or a level), how they fade, how much they
jitter, and which stretch of points is altered in what way.  Every number that a curve needs is a hash of seed,
index and a slot, so a batch of curves is a handful of matrices and any split of the indexes draws the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from curvelake.kernels import growth

Range = tuple[float, float]


@dataclass(frozen=True)
class Stretch:
    """Points from a share of the curve on (for some points, or to the end): times ``keep``, less ``sink`` of the peak.

    ``frozen``: the first value of the stretch stands for all of it.  ``ramp``: the loss grows evenly from none to all.
    """

    begin: Range
    points: tuple[int, int] | None = None
    keep: Range = (1.0, 1.0)
    sink: Range = (0.0, 0.0)
    frozen: bool = False
    ramp: bool = False


@dataclass(frozen=True)
class Kind:
    """``short`` ranges hold up to 16 hours, ``long`` ones for longer curves where they differ."""

    valid: bool
    number: int
    mu: Range = (0.2, 1.5)
    lam: Range = (0.0, 10.0)
    lam_long: Range | None = None
    waves: bool = False
    level: Range | None = None
    fade_start: Range | None = None
    fade_start_long: Range | None = None
    fade_rate: Range = (0.0, 0.0)
    jitter: float = 0.0
    stretches: tuple[Stretch, ...] = ()  # each curve gets one of them


#: Kinds of a set of 900 curves, their numbers and the ranges of what is drawn.
KINDS = {
    "plain": Kind(True, 203),
    "fast": Kind(True, 100, mu=(0.9, 1.5), lam=(0.0, 2.0)),
    "late": Kind(True, 100, mu=(0.8, 1.5), lam=(8.0, 12.0), lam_long=(10.0, 16.0)),
    "decline": Kind(True, 100, fade_start=(8.0, 12.0), fade_start_long=(10.0, 14.0), fade_rate=(0.03, 0.15)),
    "obvious": Kind(False, 80, stretches=(Stretch((1 / 3, 2 / 3), keep=(0.0, 0.2), frozen=True), Stretch((1 / 2, 1.0), keep=(0.05, 0.25)))),
    "diauxic": Kind(False, 60, waves=True),
    "subtle": Kind(False, 60, stretches=(Stretch((1 / 4, 3 / 4), points=(2, 5), sink=(0.1, 0.4)),)),
    "nearreal": Kind(False, 55, stretches=(Stretch((0.6, 0.6), keep=(0.4, 0.8), sink=(0.05, 0.15), ramp=True),)),
    "decline_only": Kind(False, 55, level=(0.4, 1.2), fade_start=(0.0, 0.0), fade_rate=(0.05, 0.2)),
    "noise": Kind(False, 45, level=(0.05, 0.2), jitter=0.2),
    "nogrowth": Kind(False, 42, level=(0.0, 0.1)),
}
COMPOSITION = [(k.valid, name, k.number) for name, k in KINDS.items()]
SET_SIZE = sum(n for _, _, n in COMPOSITION)

#: Ranges that all growing curves share, and what is done to valid ones.
A, NU, ALPHA, SHIFT_OF_HORIZON = (0.5, 2.0), (0.5, 2.0), (0.0, 0.15), (0.4, 0.7)
WAVE_A, WAVE_MU, WAVE_LAMS = (0.3, 1.0), (0.2, 1.2), ((0.0, 5.0), (5.0, 15.0))
HIGH_QUALITY, QUIET = 0.30, 0.3
MISSING_CURVES, MISSING_POINTS = 0.10, 0.10
OUTLIER_CURVES, OUTLIER_POINTS, OUTLIER_DROP = 0.05, 0.05, (0.10, 0.30)
FAMILIES = ["Gompertz", "Logistic", "ModifiedGompertz", "Richards"]

_U = np.uint64
_SLOTS = ["family", "a", "mu", "lam", "nu", "alpha", "shift", "a2", "mu2", "lam2", "level", "start", "rate", "choice", "begin", "points", "keep", "sink", "quiet", "missing", "outlier"]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Draws:
    """Uniform and normal numbers of each curve by slot."""

    def __init__(self, seed: int, index: np.ndarray):
        self.key = _mix(_mix(np.asarray(index, dtype=np.uint64) + _U(1)) ^ _U(seed % (1 << 63)))

    def _at(self, slots: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(self.key[:, None] + (slots.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)[None]) >> _U(11)) / float(1 << 53)

    def u(self, name: str) -> np.ndarray:
        """A column of one uniform number per curve."""
        return self._at(np.array([_SLOTS.index(name)]))

    def within(self, name: str, ranges: np.ndarray) -> np.ndarray:
        """ranges: low and high per curve."""
        return ranges[:, :1] + (ranges[:, 1:] - ranges[:, :1]) * self.u(name)

    def points(self, block: int, n: int) -> np.ndarray:
        """A uniform number per curve and point; blocks are independent."""
        return self._at(len(_SLOTS) + block * n + np.arange(n))

    def normal(self, block: int, n: int) -> np.ndarray:
        return np.sqrt(-2 * np.log1p(-self.points(block, n))) * np.cos(2 * np.pi * self.points(block + 1, n))


def plan(seed: int) -> list[tuple[bool, str]]:
    """Class and kind of each index of a set, dealt by the seed."""
    cards = [(valid, name) for valid, name, n in COMPOSITION for _ in range(n)]
    return [cards[i] for i in np.random.default_rng(seed).permutation(len(cards))]


def bounded_gompertz(t, a, mu, lam, alpha, shift):
    """A second, saturating phase of height alpha * a sets in at ``shift``; unlike the fitted form it stays bounded."""
    t = np.atleast_2d(t)
    p = [np.broadcast_to(np.asarray(v, float).reshape(-1, 1), (len(t), 1)) for v in (a, mu, lam, alpha, shift)]
    rise, _ = growth.WITH_JACOBIAN["gompertz"](t, np.concatenate([np.zeros((len(t), 1)), *p[:3]], axis=1))
    return rise - p[3] * p[0] * np.expm1(-np.maximum(t - p[4], 0.0))


def _rising(draws: Draws, kinds: list[Kind], t: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    family = np.minimum((draws.u("family")[:, 0] * len(FAMILIES)).astype(int), len(FAMILIES) - 1)
    lams = np.array([k.lam if top <= 16 or not k.lam_long else k.lam_long for k in kinds])
    lams[:, 1] = np.maximum(np.minimum(lams[:, 1], top), lams[:, 0])
    same = lambda r: np.repeat([r], len(kinds), axis=0)
    p = np.concatenate([np.zeros((len(kinds), 1)), draws.within("a", same(A)), draws.within("mu", np.array([k.mu for k in kinds])), draws.within("lam", lams), draws.within("nu", same(NU))], axis=1)
    alpha, shift = draws.within("alpha", same(ALPHA)), top * draws.within("shift", same(SHIFT_OF_HORIZON))
    y = np.empty_like(t)
    for k, name in enumerate(FAMILIES):
        at = family == k
        if name == "ModifiedGompertz":
            y[at] = bounded_gompertz(t[at], p[at, 1], p[at, 2], p[at, 3], alpha[at], shift[at])
        else:
            y[at] = growth.WITH_JACOBIAN[name.lower()](t[at], p[at] if name == "Richards" else p[at, :4])[0]
    return np.array(FAMILIES, dtype=object)[family], y


def _altered(y: np.ndarray, draws: Draws, kinds: list[Kind]) -> np.ndarray:
    """Each curve's stretch, drawn from those of its kind."""
    n = y.shape[1]
    choice = draws.u("choice")[:, 0]
    own = [k.stretches[int(c * len(k.stretches))] if k.stretches else None for k, c in zip(kinds, choice, strict=True)]
    rows = np.array([i for i, s in enumerate(own) if s is not None], dtype=int)
    if not len(rows):
        return y
    column = lambda f: np.array([f(own[i]) for i in rows])
    pick = lambda name, ranges: (ranges[:, 0] + (ranges[:, 1] - ranges[:, 0]) * draws.u(name)[rows, 0])[:, None]
    begin = np.minimum(np.floor(pick("begin", column(lambda s: s.begin)) * n), n - 2).astype(int)
    width = np.floor(pick("points", column(lambda s: (s.points[0], s.points[1] + 1) if s.points else (n, n)))).astype(int)
    place, part = np.arange(n)[None], y[rows]
    base = np.where(column(lambda s: s.frozen)[:, None], np.take_along_axis(part, begin, axis=1), part)
    grown = np.where(column(lambda s: s.ramp)[:, None], (place - begin) / np.maximum(n - 1 - begin, 1), 1.0)
    kept = base * pick("keep", column(lambda s: s.keep))
    loss = pick("sink", column(lambda s: s.sink)) * np.where((place >= begin) & (place < begin + width), kept, part).max(axis=1, keepdims=True) * grown
    out = y.copy()
    out[rows] = np.where((place >= begin) & (place < begin + width), np.maximum(kept - loss, 0.0), part)
    return out


def _lowest(u: np.ndarray, share: float) -> np.ndarray:
    """Marks a share of each row, one at least."""
    return u.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < max(1, round(share * u.shape[1]))


def curves(names: list[str], index: np.ndarray, t: np.ndarray, noise: float = 0.05, seed: int = 123) -> tuple[list[str], np.ndarray]:
    """(model names, values with NaN where points are missing): a row per curve."""
    kinds, draws, n, top = [KINDS[k] for k in names], Draws(seed, index), len(t), float(t.max())
    times = np.repeat(t[None], len(kinds), axis=0)
    family, y = _rising(draws, kinds, times, top)
    waves, flat = np.array([k.waves for k in kinds]), np.array([k.level is not None for k in kinds])
    if waves.any():
        same = lambda r: np.repeat([(r[0], min(r[1], max(top, r[0])))], len(kinds), axis=0)
        both = [np.concatenate([np.zeros((len(kinds), 1)), draws.within(a, same(WAVE_A)), draws.within(m, same(WAVE_MU)), draws.within(x, same(lam))], axis=1) for a, m, x, lam in (("a", "mu", "lam", WAVE_LAMS[0]), ("a2", "mu2", "lam2", WAVE_LAMS[1]))]
        y[waves] = sum(growth.WITH_JACOBIAN["logistic"](times, p)[0] for p in both)[waves]
        family[waves] = "Diauxic"
    y[flat] = draws.within("level", np.array([k.level or (0.0, 0.0) for k in kinds]))[flat]
    family[flat] = "Flat"
    starts = np.array([(k.fade_start_long if top > 16 and k.fade_start_long else k.fade_start) or (0.0, 0.0) for k in kinds])
    y = y * np.exp(-draws.within("rate", np.array([k.fade_rate for k in kinds])) * np.maximum(times - t.min() - draws.within("start", starts), 0.0))
    y = _altered(y, draws, kinds)
    y = np.maximum(y + np.array([[k.jitter] for k in kinds]) * draws.normal(0, n), 0.0)
    valid = np.array([[k.valid] for k in kinds])
    y = y + noise * np.where(valid & (draws.u("quiet") < HIGH_QUALITY), QUIET, 1.0) * draws.normal(2, n)
    lost = valid & (draws.u("missing") < MISSING_CURVES) & _lowest(draws.points(4, n), MISSING_POINTS)
    struck = valid & (draws.u("outlier") < OUTLIER_CURVES) & _lowest(draws.points(5, n), OUTLIER_POINTS)
    y = np.where(struck, y - (OUTLIER_DROP[0] + (OUTLIER_DROP[1] - OUTLIER_DROP[0]) * draws.points(6, n)), y)
    return family.tolist(), np.where(lost, np.nan, np.maximum(y, 0.0))


def curve(valid: bool, kind: str, index: int, t: np.ndarray, noise: float = 0.05, seed: int = 123) -> tuple[str, np.ndarray]:
    """One curve of a batch."""
    family, y = curves([kind], np.array([index]), t, noise, seed)
    return family[0], y[0]
