"""Language-model scores by deleted interpolation.

A token's probability is a mixture of n-gram maximum-likelihood estimates of each order and a uniform
one; the weights depend on how often the longest seen context occurs (logarithmic buckets) and are learned
by expectation-maximisation on held-out documents, with counts from which those documents are deleted.

All counts are exact and cover all training documents.  They never meet in one place: texts are coded in
blocks of about a million tokens, each block asks for the totals of its distinct n-grams by key range,
the task of a range sums what all blocks sent it and replies to each block in the order of its request.
So a frequent n-gram costs one entry a block, not one a document, and neither the driver nor any task
holds the model.  Each order has an exchange of its own, so its size is that of the longest n-grams alone.  The driver gets the number of tokens and types, and the mixture statistics: one count
per cell of quantised probabilities, whose number is bounded by the grid; its steps grow with the logarithm
of the number of tokens, so no estimate is clipped.

Tokens: A-Z lower-cased, cut at white space (0x20, 0x09-0x0D), then one end of text.
Cases: null and empty texts are one end token; repeated rows count and score as often as they occur; a
null id counts as training; with no training text every count is 0 and the model is uniform; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch, planned_bytes

_U = np.uint64
_END, _BEGIN = T.mix(np.array([0xE0D, 0xB09], dtype=np.uint64))
_BUCKETS, _STEPS = 24, 48


def _pack(x: np.ndarray) -> bytes:
    """Bytes of the same weight together, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(raw: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(dtype)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=_U(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


@dataclass
class Coded:
    """A block of documents as token hashes; deleted ones are those the weights are learned from."""

    words: np.ndarray
    length: np.ndarray
    train: np.ndarray
    held: bool

    def grams(self, order: int) -> list[np.ndarray]:
        """Per order the hash of the n-gram that ends at each token; before a text stand begin marks."""
        first = np.cumsum(self.length) - self.length
        out, before = [self.words], self.words
        for n in range(1, order):
            before = np.roll(before, 1)
            for k in range(n):  # the k-th token of a text has k words before it
                at = first[self.length > k] + k
                if k == n - 1:
                    before[at] = _BEGIN
                elif n > 1:
                    before[at] = T.mix(_BEGIN + _U(k))
            with np.errstate(over="ignore"):
                out.append(T.mix(out[-1] * _U(0x9FB21C651E98DF25) + T.mix(before + _U(n))))
        return out


def _contexts(coded: Coded, counts: list[np.ndarray], texts: float, tokens: float) -> list[np.ndarray]:
    """Per order the count of the context before each token."""
    first = np.cumsum(coded.length) - coded.length
    out = [np.full(len(coded.words), tokens)]
    for c in counts[:-1]:
        before = np.roll(c, 1)
        before[first] = texts
        out.append(before)
    return out


def context_buckets(tokens: float) -> int:
    """Buckets of context counts, one a power of two up to the number of all tokens; ``_BUCKETS`` at least."""
    return max(_BUCKETS, int(tokens).bit_length() + 1)


def _bucket(contexts: list[np.ndarray], buckets: int = _BUCKETS) -> np.ndarray:
    """The longest context that occurs, and the logarithm of its count."""
    bucket = np.zeros(len(contexts[0]), dtype=np.int64)
    for level, c in enumerate(contexts[1:], 1):
        seen = c > 0
        bucket[seen] = level * buckets + np.minimum(np.log2(c[seen]).astype(np.int64), buckets - 1)
    return bucket


def _estimates(counts: list[np.ndarray], contexts: list[np.ndarray], types: float) -> np.ndarray:
    """Rows: the uniform estimate, then one per order."""
    rows = [np.full(len(counts[0]), 1.0 / (types + 1))]
    rows += [c / np.maximum(x, 1.0) for c, x in zip(counts, contexts, strict=True)]
    return np.stack(rows)


def grid_steps(tokens: float) -> int:
    """Steps of half a bit down to the rarest estimate there is, one of all tokens; ``_STEPS`` at least."""
    return max(_STEPS, 2 * math.ceil(math.log2(max(tokens, 1.0))) + 2)


def code_cells(bucket: np.ndarray, p: np.ndarray, steps: int) -> np.ndarray:
    """One number for the bucket and the step of each order's estimate; the last order stands first, 0 has the step ``steps``."""
    cell = bucket
    with np.errstate(divide="ignore"):
        for row in p[::-1]:
            step = np.where(row > 0, np.minimum(np.rint(-2 * np.log2(np.maximum(row, 1e-300))), steps - 1), steps).astype(np.int64)
            cell = cell * (steps + 1) + step
    return cell


def learn_weights(cells: np.ndarray, counts: np.ndarray, order: int, types: float, rounds: int = 60, grid: int = _STEPS, buckets: int = _BUCKETS) -> np.ndarray:
    """EM over cells (bucket, then a step per order): a row of weights (uniform first) for each bucket; ``grid`` is the cells' number of steps, ``buckets`` that of buckets an order."""
    n = order * buckets
    weights = np.zeros((n, order + 1))
    levels = np.arange(n) // buckets
    for b in range(n):
        weights[b, : levels[b] + 2] = 1.0 / (levels[b] + 2)
    if not len(cells):
        return weights
    steps, bucket = cells.copy(), None
    columns = []
    for _ in range(order):
        columns.append(steps % (grid + 1))
        steps //= grid + 1
    bucket = steps
    p = np.stack([np.full(len(cells), 1.0 / (types + 1)), *(np.where(c == grid, 0.0, 2.0 ** -(c / 2.0)) for c in columns)], axis=1)
    pooled = np.zeros((order, order + 1))
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (counts / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.zeros_like(weights)
        np.add.at(sums, bucket, share)
        for level in range(order):
            pooled[level] = sums[levels == level].sum(axis=0)
        total = pooled.sum(axis=1, keepdims=True)
        prior = np.where(total > 0, pooled / np.maximum(total, 1e-300), 0)
        for b in range(n):  # a bucket with few tokens leans on its level; no weight falls to 0
            allowed = np.arange(order + 1) <= levels[b] + 1
            lean = prior[levels[b]] if total[levels[b]] > 0 else weights[b]
            row = np.where(allowed, sums[b] + 5 * lean + 1e-3, 0)
            weights[b] = row / row.sum()
    return weights


def _code(order: int):
    """Texts to blocks; those held for the weights go to blocks of their own."""

    def run(batches, tokens=1 << 20):
        from pyspark import TaskContext

        pid, seq, open_ = TaskContext.get().partitionId(), 0, {False: [], True: []}

        def flush(held):
            nonlocal seq
            parts, open_[held] = open_[held], []
            words = np.concatenate([p[0] for p in parts])
            vocabulary, codes = np.unique(words, return_inverse=True)
            length, train = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            ids = pa.concat_arrays([p[3] for p in parts])
            seq += 1
            n_train = int(length[train].sum())
            row = [(pid << 32) | seq, held, _pack_sorted(vocabulary), _pack(codes.astype(np.uint32)), length, train, ids, n_train, int(train.sum()), n_train if held else 0, int(train.sum()) if held else 0]
            types = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([list(x) if isinstance(x, np.ndarray) else x.to_pylist() if isinstance(x, pa.Array) else x], t) for x, t in zip(row, types, strict=True)], names=_CODED)

        for batch in batches:
            train = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            held = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool) & train
            for block in T.blocks(batch.column(1), lower=True):
                spans = block.words(T.SPACED)
                n = np.diff(spans.first)
                words = np.full(len(spans.start) + len(block), _END, dtype=np.uint64)
                words[np.arange(len(spans.start)) + spans.doc] = block.hashes(spans.start, spans.end)
                here, rows = held[block.row : block.row + len(block)], np.arange(block.row, block.row + len(block))
                for kind in (False, True):
                    pick = here == kind
                    if pick.any():
                        open_[kind].append((words[np.repeat(pick, n + 1)], n[pick] + 1, train[rows[pick]], batch.column(0).take(pa.array(rows[pick]))))
                        if sum(len(p[0]) for p in open_[kind]) >= tokens:
                            yield flush(kind)
        for kind in (False, True):
            if open_[kind]:
                yield flush(kind)

    return run


_CODED = ["block", "held", "vocabulary", "codes", "length", "train", "doc_id", "n_train", "texts", "n_held", "texts_held"]
_CODED_SCHEMA = "block long, held boolean, vocabulary binary, codes binary, length array<long>, train array<boolean>, doc_id array<long>, n_train long, texts long, n_held long, texts_held long"


def _decode(row: dict) -> Coded:
    words = _unpack_sorted(row["vocabulary"])[_unpack(row["codes"], np.uint32)]
    return Coded(words, np.asarray(row["length"], dtype=np.int64), np.asarray(row["train"], dtype=bool), row["held"])


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Offsets of each range of keys in sorted keys; parts is a power of two."""
    edges = np.arange(1, parts, dtype=np.uint64) << _U(64 - parts.bit_length() + 1)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _ask(level: int, parts: int):
    """Blocks to requests: the distinct n-grams of one order in each key range with their counts in this block."""

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):  # one block at a time
                row = batch.slice(at, 1).to_pylist()[0]
                coded = _decode(row)
                keys, inverse = np.unique(coded.grams(level + 1)[level], return_inverse=True)
                counts = np.bincount(inverse[np.repeat(coded.train, coded.length)], minlength=len(keys)).astype(np.uint32)
                cut = _ranges(keys, parts)
                full = np.flatnonzero(np.diff(cut))
                for k in range(0, len(full), 512):
                    pieces = [slice(cut[p], cut[p + 1]) for p in full[k : k + 512]]
                    columns = [pa.array(full[k : k + 512], pa.int32()), pa.array([row["block"]] * len(pieces), pa.int64()), pa.array([row["held"]] * len(pieces)), pa.array([_pack_sorted(keys[x]) for x in pieces], pa.binary()), pa.array([_pack(counts[x]) for x in pieces], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "held", "keys", "counts"])
            T.give_back()

    return run


_ASK_SCHEMA = "part int, block long, held boolean, keys binary, counts binary"


def _answer(table: pa.Table) -> pa.Table:
    """The task of a key range: totals over all blocks, back to each block in the order it asked."""
    rows = table.to_pylist()
    keys = [_unpack_sorted(r["keys"]) for r in rows]
    sizes = [len(k) for k in keys]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.concatenate([_unpack(r["counts"], np.uint32) for r in rows]).astype(np.float64)
    del keys
    from_held = np.repeat([r["held"] for r in rows], sizes)
    total = np.bincount(inverse, weights=count, minlength=len(distinct)).astype(np.uint64)
    retained = total - np.bincount(inverse[from_held], weights=count[from_held], minlength=len(distinct)).astype(np.uint64)
    out, at = [], 0
    for r, n in zip(rows, sizes, strict=True):
        asked = inverse[at : at + n]
        out.append((r["block"], r["held"], r["part"], _pack(total[asked]), _pack(retained[asked]) if r["held"] else None, 0, 0))
        at += n
    out.append((None, False, rows[0]["part"], None, None, int((total > 0).sum()), int((retained > 0).sum())))
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "held", "part", "total", "retained", "types", "retained_types"])


_ANSWER_SCHEMA = "block long, held boolean, part int, total binary, retained binary, types long, retained_types long"


def _token_counts(table: pa.Table, order: int, which: str) -> tuple[dict, Coded, list[np.ndarray]]:
    """A block and its replies: per order the total of the n-gram that ends at each token."""
    rows = table.to_pylist()
    row = next(r for r in rows if r["vocabulary"] is not None)
    replies = sorted((r for r in rows if r["vocabulary"] is None), key=lambda r: (r["level"], r["part"]))
    coded = _decode(row)
    counts = []
    for level, grams in enumerate(coded.grams(order)):
        _, inverse = np.unique(grams, return_inverse=True)
        counts.append(np.concatenate([_unpack(r[which], np.uint64) for r in replies if r["level"] == level])[inverse].astype(np.float64))
    return row, coded, counts


def interpolated_scores(docs: DataFrame, train: Column, held: Column, order: int = 3, range_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (smoothed unigram), score (the mixture), log10.

    ``train`` marks documents that count; those of them that ``held`` marks teach the weights.
    ``range_bytes`` is the planner's size of input per key range (ranges: a power of two, 64 at least).
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce(held, F.lit(False)).alias("held"))
    size = planned_bytes(docs) or 0
    parts = 1 << max(6, min(24, (size // range_bytes).bit_length()))
    coded = scratch.write("coded", rows.mapInArrow(_code(order), _CODED_SCHEMA))
    blocks = coded.select("block", "held", "vocabulary", "codes", "length", "train")
    # an exchange for each order: tasks and shuffle files hold the n-grams of one order at a time
    answered = [scratch.write(f"answers-{o}", blocks.mapInArrow(_ask(o, parts), _ASK_SCHEMA).groupBy("part").applyInArrow(_answer, _ANSWER_SCHEMA)) for o in range(order)]
    answers = reduce(DataFrame.unionAll, (a.withColumn("level", F.lit(o)) for o, a in enumerate(answered)))
    n = coded.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "texts", "n_held", "texts_held"))).first()
    v = answered[0].agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "retained_types"))).first()

    def together(held_only: bool) -> DataFrame:
        a, b = coded, answers.where("block is not null")
        if held_only:
            a, b = a.where("held"), b.where("held")
        nulls = lambda names: [F.lit(None).cast(t).alias(c) for c, t in names]
        left = a.select("block", "held", "vocabulary", "codes", "length", "train", "doc_id", *nulls([("level", "int"), ("part", "int"), ("total", "binary"), ("retained", "binary")]))
        right = b.select("block", "held", *nulls([("vocabulary", "binary"), ("codes", "binary"), ("length", "array<long>"), ("train", "array<boolean>"), ("doc_id", "array<long>")]), "level", "part", "total", "retained")
        return left.unionAll(right)

    tokens_left, texts_left, types_left = float(n.n_train - n.n_held), float(n.texts - n.texts_held), float(v.retained_types)
    grid, buckets = grid_steps(tokens_left), context_buckets(n.n_train)

    def cells(table: pa.Table) -> pa.Table:
        _, block, counts = _token_counts(table, order, "retained")
        contexts = _contexts(block, counts, texts_left, tokens_left)
        p = _estimates(counts, contexts, types_left)[1:]
        cell = code_cells(_bucket(contexts, buckets), p, grid)
        keys, count = np.unique(cell, return_counts=True)
        return pa.table({"cell": keys, "n": count})

    found = together(True).groupBy("block").applyInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(found["cell"].to_numpy(np.int64), found["n"].to_numpy(np.float64), order, types_left, grid=grid, buckets=buckets)
    tokens, texts, types = float(n.n_train), float(n.texts), float(v.types)

    def score(table: pa.Table) -> pa.Table:
        row, block, counts = _token_counts(table, order, "total")
        contexts = _contexts(block, counts, texts, tokens)
        p = np.empty(len(block.words))
        for k in range(0, len(p), 1 << 16):
            near = slice(k, k + (1 << 16))
            some = [x[near] for x in contexts]
            p[near] = (weights[_bucket(some, buckets)].T * _estimates([x[near] for x in counts], some, types)).sum(axis=0)
        first = np.concatenate([[0], np.cumsum(block.length)[:-1]])
        base = np.log10((counts[0] + 0.5) / (tokens + 0.5 * (types + 1)))
        sums = lambda x: np.add.reduceat(x, first)
        columns = {"doc_id": pa.array(row["doc_id"], pa.int64()), "n_tokens": block.length, "n_known": sums((counts[0] > 0).astype(np.int64)), "train_tokens": np.full(len(first), int(tokens)), "base_score": sums(base), "score": sums(np.log10(np.maximum(p, 1e-300)))}
        T.give_back()
        return pa.table(columns)

    return together(False).groupBy("block").applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
