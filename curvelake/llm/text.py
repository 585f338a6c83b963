"""Whole-batch scans of UTF-8 text in numpy, straight from Arrow's buffers.

A batch is cut into blocks of whole texts (about ``BLOCK`` bytes, one text at least), so memory
follows the block and the longest single text, never the partition.  Words, word hashes and n-gram
hashes of a block come out as flat arrays next to the index of the text they belong to.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)

#: Lower-cases A-Z and nothing else.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of words that are cut at white space: not 0x20, not 0x09-0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of ASCII digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64; kept up to the size of a few blocks."""
    if len(_POWERS["up"]) <= n:
        n = max(n, BLOCK + BLOCK // 4)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    up, down = _POWERS["up"], _POWERS["down"]
    if len(up) > 8 * BLOCK:
        _POWERS.update(up=up[: BLOCK + 1].copy(), down=down[: BLOCK + 1].copy())
    return up, down


@dataclass
class Words:
    """The words of a block: byte spans, the text each belongs to, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # n_docs + 1 word offsets


@dataclass
class Block:
    """Whole texts, one after the other: data[offset[i]:offset[i + 1]] is text i."""

    row: int
    data: np.ndarray
    offset: np.ndarray

    def __len__(self) -> int:
        return len(self.offset) - 1

    def spans(self, is_member: np.ndarray) -> Words:
        """Maximal runs of member bytes that stay inside one text."""
        n = len(self.data)
        padded = np.zeros(n + 2, dtype=bool)
        padded[1:-1] = is_member
        begins, ends = padded[1:-1] & ~padded[:-2], padded[1:-1] & ~padded[2:]
        filled = np.flatnonzero(np.diff(self.offset))
        begins[self.offset[filled]] = is_member[self.offset[filled]]
        last = self.offset[filled + 1] - 1
        ends[last] = is_member[last]
        start = np.flatnonzero(begins)
        first = np.searchsorted(start, self.offset)
        return Words(start, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(self)), np.diff(first)), first)

    def words(self, members: np.ndarray) -> Words:
        return self.spans(members[self.data])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
        up, down = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], dtype=np.uint64, out=sums[1:])
            return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = BLOCK) -> Iterator[Block]:
    """Blocks of whole texts of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, min(len(column), int(np.searchsorted(offset, offset[row] + limit, side="right")) - 1, row + 0xFFFF))
        part = data[offset[row] : offset[stop]]
        yield Block(row, ASCII_LOWER[part] if lower else part, offset[row : stop + 1] - offset[row])
        row = stop


def joined(block: Block, words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The (kept) words of each text with one space between: bytes, start and end of each word in them, where each text begins."""
    at = np.arange(len(words.start)) if keep is None else np.flatnonzero(keep)
    source, doc, size = words.start[at], words.doc[at], words.end[at] - words.start[at]
    gap = np.zeros(len(at), dtype=np.int64)
    gap[1:] = doc[1:] == doc[:-1]
    end = np.cumsum(size + gap)
    start = end - size
    before = np.cumsum(size) - size
    run = np.arange(int(size.sum()))
    data = np.full(int(end[-1]) if len(end) else 0, 0x20, dtype=np.uint8)
    data[run + np.repeat(start - before, size)] = block.data[run + np.repeat(source - before, size)]
    return data, start, end, np.concatenate([[0], end])[np.searchsorted(doc, np.arange(len(block) + 1))]


def strings(data: np.ndarray, offset: np.ndarray) -> pa.Array:
    """A string column over one buffer of bytes."""
    return pa.LargeStringArray.from_buffers(len(offset) - 1, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def give_back() -> None:
    """Hands freed memory to the system: a Python worker lives on for other tasks with the most that any of them took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive items that stay inside one text, and the index of each one's first item."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rolled = hashes[:m].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            rolled *= _STEP
            rolled += hashes[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(rolled[at]), at


def tagged(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each hash beside the index of its text (under 65,536 a block)."""
    return (hashes & _U(0xFFFFFFFFFFFF0000)) | doc.astype(np.uint64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more, the first occurrence included."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
