"""Periodic runs: maximal stretches of words that repeat with a period, and texts with the repetition taken out.

A run is a stretch of consecutive words with smallest period q, at least ``min_words`` long and ``exponent``
periods long, that no neighbouring word extends.  By the runs theorem each has a Lyndon root that is the longest
Lyndon word at its place under some order of the words or its reverse.  Phase one of Baier's suffix sorter groups
suffixes by exactly that word (``lyndon_lengths``), so running it under both orders gives the two Lyndon arrays
without sorting any suffixes; roots are then extended to both sides by longest common extensions (doubling over
prefix hashes, all at once), and every run is compared word by word, as hashes alone could err.

Only words that can be in such a run go that way: in a run of q a k-gram comes back every q words, so each of
its words lies in k-grams found several times in the text (``_needed``, an exact necessary condition for every
period).  It holds for all words of a periodic text and for few others.  Both phases take time in proportion to
the words (times a logarithm), whatever the period.

Cases: a null or empty text, or one without words, has no runs and an empty collapsed text.  Repeated rows each get their
row.  Ties of the greatest exponent go to the smallest start, then the smallest period.  A text of n words needs some 300
bytes a word where it repeats throughout, of one block or longest text at a time.  Columns other than id and text are not
read.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import text as T

_U = np.uint64


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place; negative symbols part strings and get 0.

    Groups of suffixes stand in order, first by their first symbol.  From the highest down: each member's nearest
    place to the left in a lower group is found (everything as high or higher is done, so finished places are
    skipped, with path halving); such a place's word takes on the group's word, once for each member that points
    at it, and moves into a new group right above its old one.  A place moves up once per chain of members, so
    all moves together are in proportion to the text.  symbols[0] must be negative.
    """
    order = np.argsort(symbols, kind="stable")
    order = order[np.searchsorted(symbols[order], 0) :]
    cuts = np.flatnonzero(np.diff(symbols[order])) + 1
    members: list[list[int]] = [part.tolist() for part in np.split(order, cuts)] if len(order) else []
    size = [1] * len(members)
    lower, higher = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    starts = np.zeros(len(symbols), dtype=np.int64)
    starts[order] = np.repeat(np.arange(len(members)), np.diff([0, *cuts, len(order)])) if len(order) else 0
    group, skip, apart = starts.tolist(), list(range(len(symbols))), (symbols < 0).tolist()
    out = [0] * len(symbols)
    now = len(members) - 1
    while now >= 0:
        held = [i for i in members[now] if group[i] == now]
        members[now] = []
        own = size[now]
        for i in held:
            skip[i] = i - 1
            out[i] = own
        pointed: dict[int, int] = {}
        for i in held:
            j = i - 1
            while skip[j] != j:
                skip[j] = skip[skip[j]]
                j = skip[j]
            if not apart[j]:
                pointed[j] = pointed.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moved.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moved, reverse=True):  # the most repeated stand highest
            new = len(size)
            size.append(size[old] + times * own)
            members.append(moved[times, old])
            up = higher[old]
            lower.append(old)
            higher.append(up)
            higher[old] = new
            if up < new:
                lower[up] = new
            for j in members[new]:
                group[j] = new
        now = lower[now]
    return np.array(out, dtype=np.int64)


class _Extender:
    """Common extensions of pairs of places, to the right and to the left."""

    def __init__(self, symbols: np.ndarray):
        parts = np.flatnonzero(symbols < 0)
        values = symbols.astype(np.uint64) + _U(1)
        values[parts] = (parts + (1 << 40)).astype(np.uint64)  # no two separators are equal
        up, self.down = T._powers(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(T.mix(values) * up[: len(symbols)], dtype=np.uint64, out=self.sums[1:])
        self.bits = int(np.diff(np.append(parts, len(symbols))).max(initial=1)).bit_length()

    def _same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[a + n] - self.sums[a]) * self.down[a] == (self.sums[b + n] - self.sums[b]) * self.down[b]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from a < b on."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(self.bits)):
            fits = np.flatnonzero(b + got + (1 << k) < len(self.sums))
            fits = fits[self._same(a[fits] + got[fits], b[fits] + got[fits], 1 << k)]
            got[fits] += 1 << k
        return got

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols before a < b."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(self.bits)):
            fits = np.flatnonzero(a - got >= 1 << k)
            fits = fits[self._same(a[fits] - got[fits] - (1 << k), b[fits] - got[fits] - (1 << k), 1 << k)]
            got[fits] += 1 << k
        return got


def _exact(symbols: np.ndarray, root: int, period: int) -> tuple[int, int]:
    """The stretch around a root that keeps the period, symbol by symbol."""
    start, end = root, root + period
    while symbols[start - 1] == symbols[start - 1 + period] and symbols[start - 1] >= 0:
        start -= 1
    while end < len(symbols) and symbols[end] == symbols[end - period] and symbols[end] >= 0:
        end += 1
    return start, end


def runs_of(symbols: np.ndarray, min_words: int, exponent: int) -> np.ndarray:
    """start, end, period of all runs, a row each; strings are parted by negative symbols, symbols[0] is one."""
    top, extend, found = int(symbols.max(initial=0)), None, []
    for ordered in (symbols, np.where(symbols < 0, symbols, top - symbols)):
        length = lyndon_lengths(ordered)
        at = np.flatnonzero(length)
        # A run of this exponent holds exponent - 1 whole copies of the root from its first one on, which is within
        # the first period; each but the last two periods' ends has the root's length in the array.
        for k in range(1, exponent - 1):
            later = at + k * length[at]
            inside = later < len(symbols)
            at = at[inside][length[later[inside]] == length[at[inside]]]
        period = length[at]
        good = np.flatnonzero(at + period < len(symbols))
        at, period = at[good], period[good]
        good = np.flatnonzero(symbols[at] == symbols[at + period])
        at, period = at[good], period[good]
        if len(at):
            extend = extend or _Extender(symbols)
            found.append(np.stack([at, at - extend.left(at, at + period), at + period + extend.right(at, at + period), period], axis=1))
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    rows = np.concatenate(found)
    rows = rows[rows[:, 2] - rows[:, 1] >= np.maximum(min_words, exponent * rows[:, 3])]
    _, first = np.unique(rows[:, 1:], axis=0, return_index=True)
    checked = set()
    for root, start, end, period in rows[first].tolist():
        if not np.array_equal(symbols[start : end - period], symbols[start + period : end]):
            start, end = _exact(symbols, root, period)
        if end - start >= max(min_words, exponent * period):
            checked.add((start, end, period))
    return np.array(sorted(checked), dtype=np.int64).reshape(-1, 3)


def _needed(min_words: int, exponent: int) -> list[tuple[int, int]]:
    """(k, count): each word of a run is in a k-gram found so many times in its text; the longest k for each count from 2 up."""
    best = {}
    for k in range(1, min_words + 1):
        count = min((max(min_words, exponent * q) - k + 1) // q for q in range(1, max(min_words, k) + 2))
        if count > 1:
            best[count] = k
    return [(k, count) for count, k in sorted(best.items()) if k > 1]


def _candidates(codes: np.ndarray, doc: np.ndarray, min_words: int, exponent: int) -> np.ndarray:
    """True for words that may be in a run."""
    may = np.ones(len(codes), dtype=bool)
    hashes = T.mix(codes.astype(np.uint64) + _U(1))
    for k, count in _needed(min_words, exponent):
        grams, at = T.ngrams(hashes, doc, k)
        with np.errstate(over="ignore"):
            grams = T.mix(grams + doc[at].astype(np.uint64) * T._BASE)
        ordered = np.sort(grams)
        often = np.unique(ordered[count - 1 :][ordered[count - 1 :] == ordered[: len(ordered) - count + 1]])
        if not len(often):
            return np.zeros(len(codes), dtype=bool)
        place = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        edges = np.zeros(len(codes) + 1, dtype=np.int32)
        hit = at[often[place] == grams]
        edges[hit] += 1
        np.subtract.at(edges, hit + k, 1)
        may &= np.cumsum(edges[:-1]) > 0
    return may


def find_runs(codes: np.ndarray, doc: np.ndarray, min_words: int = 6, exponent: int = 4) -> np.ndarray:
    """start, end, period in word positions of the block; equal words have equal codes."""
    may = np.concatenate([[False], _candidates(codes, doc, min_words, exponent), [False]])
    change = np.flatnonzero(may[1:] != may[:-1])
    begin, end = change[::2], change[1::2]
    parts = np.unique(np.concatenate([begin, np.flatnonzero(np.diff(doc)) + 1]))  # texts part stretches, too
    parts = parts[may[parts + 1]] if len(parts) else parts
    stop = np.minimum(end[np.searchsorted(end, parts, side="right")], np.append(parts[1:], len(codes))) if len(parts) else parts
    long = stop - parts >= min_words
    parts, stop = parts[long], stop[long]
    if not len(parts):
        return np.zeros((0, 3), dtype=np.int64)
    size = stop - parts
    first = np.cumsum(size + 1) - size  # place of each stretch behind its separator
    place = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
    word = np.arange(int(size.sum())) + np.repeat(parts - (np.cumsum(size) - size), size)
    symbols = np.full(int(size.sum()) + len(size), -1, dtype=np.int64)
    _, symbols[place] = np.unique(codes[word], return_inverse=True)
    found = runs_of(symbols, min_words, exponent)
    if len(found):
        of = np.searchsorted(first, found[:, 0], side="right") - 1
        found[:, :2] += (parts - first)[of][:, None]
    return found


def _longer(a: tuple, b: tuple) -> int:
    """Order of (start, length, period): greater length/period first, then start, then period."""
    left, right = a[1] * b[2], b[1] * a[2]
    return -1 if left > right or (left == right and (a[0], a[2]) < (b[0], b[2])) else 1


def periodic_runs(docs: DataFrame, min_words: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_runs, start, length, period, exponent_milli of the most repeated run, all runs, the collapsed text.

    Collapsed: the words, joined by one space, without those that a run contains after its first period.
    """
    src = docs.select(id_col, text_col)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = [id_col, "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]

    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                words = block.words(T.SPACED)
                data, start, end, _ = T.joined(block, words)
                pieces = T.strings(data, np.append(start, len(data))) if len(start) else pa.array([], pa.string())
                codes = pc.dictionary_encode(pc.ascii_rtrim(pieces, " ")).indices.to_numpy()
                found = find_runs(codes, words.doc, min_words, exponent)
                edges = np.zeros(len(start) + 1, dtype=np.int32)
                np.add.at(edges, found[:, 0] + found[:, 2], 1)
                np.subtract.at(edges, found[:, 1], 1)
                kept = np.cumsum(edges[:-1]) == 0
                if not kept.all():
                    data, _, _, offset = T.joined(block, words, kept)
                else:
                    offset = np.concatenate([[0], end])[words.first]
                rows: list[list[tuple]] = [[] for _ in range(len(block))]
                for s, e, q in found.tolist():
                    d = int(words.doc[s])
                    rows[d].append((s - int(words.first[d]), e - s, q))
                best = [min(r, key=cmp_to_key(_longer)) if r else (None, None, None) for r in rows]
                milli = [None if b[0] is None else 1000 * b[1] // b[2] for b in best]
                as_long = lambda v: pa.array(v, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.row, len(block)), as_long(np.diff(words.first)), as_long([len(r) for r in rows]), *(as_long([b[k] for b in best]) for k in range(3)), as_long(milli),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in sorted(r, key=lambda x: (x[0], x[2]))] for r in rows], run_type), T.strings(data, offset),
                    ],
                    names=names,
                )

    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
