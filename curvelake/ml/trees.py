"""Tree ensembles grown as Spark aggregates: histogram boosting, and a forest on balanced bootstrap samples.

Features are cut at quantiles into bins once; bin ``MISSING`` holds nulls.  All nodes of one level (of the boosted tree, or of
all trees of the forest at once) are grown by one job: tasks find each row's node in the trees so far and add its
statistics to histograms by node, feature slot and bin; histograms of one tree and slot are summed in one stream, which
keeps a single one in memory, and only the best split of each node and slot comes to the driver.  Statistics are whole
numbers (counts, or gradients in units of 2**-24), so sums don't depend on the partitioning.

A table of up to ``ROWS_A_PARTITION`` rows is one partition; there the same levels run one after the other within a task (a
copy of the rows for each of several tasks that share the forest's trees), with the same trees as result.  Boosting
writes the scores so far every few rounds, so rows pass only the latest trees.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.sinks import Written, write_text

#: The bin of nulls; bins below it hold values up to their edge.
MISSING = 255
UNIT = float(1 << 24)
_BLOCK = 1 << 16
_U = np.uint64


@dataclass
class Tree:
    """Nodes in order of growth, node 0 the root: a feature of -1 marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node], self.right[node] = feature, cut, missing_left, left, left + 1
        for _ in range(2):
            for column, blank in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                column.append(blank)
        return left, left + 1

    def packed(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in (self.feature, self.bin, self.missing_left, self.left, self.right, self.value))


def leaves(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node that each row (of bins) ends in."""
    feature, cut, missing_left, left, right, _ = tree
    node, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        b = bins[row, np.maximum(f, 0)]
        goes_left = np.where(b == MISSING, missing_left[node], b <= cut[node])
        node = np.where(inner, np.where(goes_left, left[node], right[node]), node)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 25.0)])))


def bootstrap_counts(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row stands in a tree's sample: Poisson of mean one, by a hash of seed, tree and row alone."""
    start = mix(np.array([seed * 1_000_003 + tree + 1], dtype=np.uint64))
    u = (mix(mix(row.view(np.uint64)) ^ start) >> _U(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, u, side="right")


# splits


def newton_gain(total: np.ndarray, left: np.ndarray, l2: float, min_rows: int, min_hessian: float = 1e-3) -> np.ndarray:
    """Gain of splits by gradient, hessian (units of 2**-24) and rows; -inf where a side has too little."""
    right = total - left
    score = lambda s: (s[..., 0] / UNIT) ** 2 / np.maximum(s[..., 1] / UNIT + l2, 1e-12)
    ok = np.minimum(left[..., 2], right[..., 2]) >= min_rows
    ok &= np.minimum(left[..., 1], right[..., 1]) >= min_hessian * UNIT
    return np.where(ok, score(left) + score(right) - score(total), -np.inf)


def gini_gain(total: np.ndarray, left: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Decrease of weighted Gini impurity by class counts; -inf where a side is empty."""
    right = total - left

    def purity(s):
        w = s * weight
        return (w**2).sum(-1) / np.maximum(w.sum(-1), 1e-300)

    ok = (left.sum(-1) > 0) & (right.sum(-1) > 0)
    return np.where(ok, purity(left) + purity(right) - purity(total), -np.inf)


def best_splits(hist: np.ndarray, gain_of: Callable) -> tuple[np.ndarray, ...]:
    """Per node of hist (node, bin, statistic): gain, bin, whether nulls go left, left statistics, total.

    A node without nulls sends later ones to its larger side.  Of equal gains the first bin wins, nulls right before left.
    """
    known = np.cumsum(hist[:, :MISSING], axis=1)
    null = hist[:, MISSING]
    total = known[:, -1] + null
    both = np.stack([known, known + null[:, None]], axis=2)  # node, bin, side of nulls, statistic
    gain = gain_of(total[:, None, None], both)
    gain[..., 1] = np.where((null == 0).all(-1)[:, None], -np.inf, gain[..., 1])
    flat = gain.reshape(len(hist), -1)
    best = flat.argmax(axis=1)
    node = np.arange(len(hist))
    cut, side = best // 2, best % 2
    left = both[node, cut, side]
    size = lambda s: s[..., -1] if s.shape[-1] == 3 else s.sum(-1)
    goes_left = np.where((null == 0).all(-1), size(left) >= size(total - left), side == 1)
    return flat[node, best], cut, goes_left, left, total


SPLITS = "tree int, slot int, gain binary, cut binary, missing_left binary, left binary, total binary"
TREES = "tree int, feature array<int>, bin array<int>, missing_left array<boolean>, left array<int>, right array<int>, value array<double>"
_NODES = ("feature", "bin", "missing_left", "left", "right", "value")


def _split_row(tree: int, slot: int, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    kinds = (np.float64, np.int64, np.bool_, np.float64, np.float64)
    blobs = [np.ascontiguousarray(x.astype(k)).tobytes() for x, k in zip(found, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([slot], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=[c.split()[0] for c in SPLITS.split(", ")])


def _tree_rows(trees: dict[int, Tree]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.float64())
    columns = {c: pa.array([getattr(t, c) for t in trees.values()], pa.list_(k)) for c, k in zip(_NODES, kinds, strict=True)}
    return pa.table({"tree": pa.array(list(trees), pa.int32()), **columns})


def _trees_of(table: pa.Table) -> dict[int, Tree]:
    return {r["tree"]: Tree(*(r[c] for c in _NODES)) for r in table.sort_by("tree").to_pylist()}


@dataclass
class Level:
    """What one job needs: open nodes per tree, each with the features it may split by; how statistics are made and judged."""

    trees: dict[int, tuple[np.ndarray, ...]]
    nodes: dict[int, np.ndarray]
    slots: dict[int, np.ndarray]  # node, slot -> feature
    statistics: Callable  # (block, tree) -> rows that count, an array (row, statistic)
    gain_of: dict[int, Callable] | Callable

    def histograms(self, block: dict[str, np.ndarray]):
        """(tree, slot, hist) of a block of rows."""
        bins = block["bins"]
        for t, tree in self.trees.items():
            rows, stats = self.statistics(block, t)
            place = np.full(len(tree[0]), -1)
            place[self.nodes[t]] = np.arange(len(self.nodes[t]))
            at = place[leaves(tree, bins[rows])]
            open_rows = np.flatnonzero(at >= 0)
            at, rows, stats = at[open_rows], rows[open_rows], stats[open_rows]
            k = len(self.nodes[t])
            for s in range(self.slots[t].shape[1]):
                cell = at * (MISSING + 1) + bins[rows, self.slots[t][at, s]]
                yield t, s, np.stack([np.bincount(cell, weights=stats[:, c], minlength=k * (MISSING + 1)) for c in range(stats.shape[1])], axis=1).reshape(k, MISSING + 1, -1)

    def within(self, block: dict[str, np.ndarray]) -> dict[int, dict[int, tuple[np.ndarray, ...]]]:
        """The best splits where a block holds all rows."""
        out: dict[int, dict[int, tuple[np.ndarray, ...]]] = {}
        for t, slot, hist in self.histograms(block):
            out.setdefault(t, {})[slot] = self.best(t, hist)
        return out

    def best(self, tree: int, hist: np.ndarray) -> tuple[np.ndarray, ...]:
        return best_splits(hist, self.gain_of if callable(self.gain_of) else self.gain_of[tree])


def _block(batches: list[pa.RecordBatch], n_features: int) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    packed = pa.concat_arrays([c.cast(pa.binary(n_features)) for c in table["bins"].chunks])
    bins = np.frombuffer(packed.buffers()[1], dtype=np.uint8)[packed.offset * n_features :][: len(table) * n_features].reshape(-1, n_features)
    return {"bins": bins} | {c: table[c].to_numpy() for c in table.column_names if c != "bins"}


def _blocks(batches, n_features: int):
    """Rows of a partition, some ten thousands at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= _BLOCK:
            yield _block(held, n_features)
            held, n = [], 0
    if held:
        yield _block(held, n_features)


def run_level(rows: DataFrame, level: Level, n_features: int) -> dict[int, dict[int, tuple[np.ndarray, ...]]]:
    """One job over all rows: tree -> slot -> best splits of its open nodes."""

    def find(batches):
        for block in _blocks(batches, n_features):
            for tree, slot, hist in level.histograms(block):
                cell = np.flatnonzero(hist.any(axis=2).ravel())
                values = hist.reshape(-1, hist.shape[2])[cell]
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([slot], pa.int32()), pa.array([cell.astype(np.int64).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["tree", "slot", "cells", "sums"])

    def merge(batches):
        now, hist = None, None
        for batch in batches:
            for tree, slot, cells, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.frombuffer(cells, dtype=np.int64)
                if not len(at):
                    continue
                width = len(sums) // 8 // len(at)
                if (tree, slot) != now:
                    if now:
                        yield _split_row(*now, level.best(now[0], hist))
                    now, hist = (tree, slot), np.zeros((len(level.nodes[tree]), MISSING + 1, width))
                hist.reshape(-1, width)[at] += np.frombuffer(sums).reshape(-1, width)
        if now:
            yield _split_row(*now, level.best(now[0], hist))

    parts = rows.mapInArrow(find, "tree int, slot int, cells binary, sums binary").repartition("tree", "slot").sortWithinPartitions("tree", "slot")
    out: dict[int, dict[int, tuple[np.ndarray, ...]]] = {}
    for r in parts.mapInArrow(merge, SPLITS).toArrow().to_pylist():
        k = len(level.nodes[r["tree"]])
        out.setdefault(r["tree"], {})[r["slot"]] = (np.frombuffer(r["gain"]), np.frombuffer(r["cut"], np.int64), np.frombuffer(r["missing_left"], np.bool_), np.frombuffer(r["left"]).reshape(k, -1), np.frombuffer(r["total"]).reshape(k, -1))
    return out


def _choose(splits: dict[int, tuple[np.ndarray, ...]], slots: np.ndarray, node: int) -> tuple:
    """The best of a node's slots: (gain, feature, cut, nulls left, left statistics, total); of equal gains the lowest feature."""
    found = [(-splits[s][0][node], int(slots[node, s]), s) for s in splits]
    gain, feature, s = min(found)
    _, cut, missing_left, left, total = splits[s]
    return -gain, feature, int(cut[node]), bool(missing_left[node]), left[node], total[node]


# ensembles


@dataclass
class Ensemble:
    """Trees over binned features: a sum that a logistic curve makes a probability, or a mean of probabilities."""

    features: list[str]
    edges: list[list[float]]
    trees: list[Tree]
    kind: str
    base: float = 0.0

    def probability(self, columns: list[str] | None = None) -> Column:
        """A column expression over the feature columns (or those named in their place); a vectorised function of whole batches."""
        edges, trees, kind, base = [np.array(e) for e in self.edges], [t.packed() for t in self.trees], self.kind, self.base

        @F.pandas_udf("double")
        def score(*columns):
            bins = np.stack([to_bins(c.to_numpy(dtype=float, na_value=np.nan), e) for c, e in zip(columns, edges, strict=True)], axis=1)
            total = np.full(len(bins), base)
            for tree in trees:
                total += tree[5][leaves(tree, bins)]
            return pd.Series(1 / (1 + np.exp(-total)) if kind == "boosting" else total / max(len(trees), 1))

        return score(*(F.col(c).cast("double") for c in columns or self.features))

    def save(self, spark: SparkSession, path: str) -> None:
        """A Parquet row per tree, the rest as a small text file beside it."""
        spark.createDataFrame(_tree_rows(dict(enumerate(self.trees)))).write.mode("overwrite").parquet(f"{path}/trees")
        write_text(spark, f"{path}/ensemble.json", json.dumps({"features": self.features, "edges": self.edges, "kind": self.kind, "base": self.base}))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        meta = json.loads(spark.read.text(f"{path}/ensemble.json", wholetext=True).first()[0])
        trees = _trees_of(spark.read.parquet(f"{path}/trees").toArrow())
        return Ensemble(meta["features"], meta["edges"], list(trees.values()), meta["kind"], meta["base"])


def to_bins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Values up to edges[k] (and above the one before) are in bin k, those above all in the last; nulls in MISSING."""
    return np.where(np.isnan(values), MISSING, np.searchsorted(edges, values, side="left")).astype(np.uint8)


def quantile_edges(df: DataFrame, features: list[str], most: int = 255) -> list[list[float]]:
    """Per feature at most ``most`` - 1 distinct cuts at quantiles of what is known; exact up to the accuracy of Spark's sketch (1e-5 of the rows)."""
    shares = [float(x) for x in np.linspace(0, 1, most + 1)[1:-1]]
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 100_000).alias(c) for c in features)).first()
    return [sorted(set(row[c] or [])) for c in features]


def binned(df: DataFrame, features: list[str], edges: list[list[float]], keep: dict[str, Column]) -> DataFrame:
    """bins (a byte per feature) and the columns of ``keep``."""
    src = df.select(*(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)), *(c.alias(n) for n, c in keep.items()))
    cuts, n, names = [np.array(e) for e in edges], len(features), ["bins", *keep]

    def run(batches):
        for batch in batches:
            bins = np.stack([to_bins(batch.column(i).to_numpy(zero_copy_only=False).astype(float), e) for i, e in enumerate(cuts)], axis=1)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(batch), [None, pa.py_buffer(np.ascontiguousarray(bins))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[n:]], names=names)

    kinds = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in keep)
    return src.mapInArrow(run, f"bins binary, {kinds}")


ROWS_A_PARTITION = 200_000


@dataclass
class Boosting:
    """How boosted trees are grown."""

    depth: int
    most_leaves: int
    rate: float
    l2: float
    min_rows: int

    def tree(self, split_level: Callable, latest: list[Tree], n_features: int) -> Tree:
        """The next tree after ``latest``, whose values aren't in the rows' scores yet."""
        tree, before = Tree(), [t.packed() for t in latest]

        def gradients(block, _):
            score = block["score"].copy()
            for t in before:
                score += t[5][leaves(t, block["bins"])]
            p = 1 / (1 + np.exp(-score))
            return np.arange(len(p)), np.stack([np.rint(block["w"] * (block["y"] - p) * UNIT), np.rint(block["w"] * p * (1 - p) * UNIT), np.ones(len(p))], axis=1)

        l2, min_rows = self.l2, self.min_rows
        nodes, gains, stats = [0], {}, {}
        for _ in range(self.depth):
            slots = np.repeat(np.arange(n_features)[None], len(nodes), axis=0)
            level = Level({0: tree.packed()}, {0: np.array(nodes)}, {0: slots}, gradients, lambda total, left: newton_gain(total, left, l2, min_rows))
            splits, opened = split_level(level)[0], []
            for i, node in enumerate(nodes):
                gain, feature, cut, missing_left, left, total = _choose(splits, slots, i)
                stats.setdefault(node, total)
                if np.isfinite(gain) and gain > 0:
                    a, b = tree.split(node, feature, cut, missing_left)
                    gains[node], stats[a], stats[b] = gain, left, total - left
                    opened += [a, b]
            nodes = opened
            if not nodes:
                break
        return _best_first(tree, gains, stats, self.most_leaves, lambda s: self.rate * float(s[0] / max(s[1] + self.l2 * UNIT, 1e-12)))


def fit_boosting(df: DataFrame, features: list[str], label: str = "y", weight: str | None = None, rounds: int = 100, depth: int = 6, most_leaves: int = 31, rate: float = 0.08, l2: float = 0.0, min_rows: int = 20, settle: int = 10, partitions: int | None = None) -> Ensemble:
    """Gradient boosting of log loss, depth-bounded trees of Newton leaves; missing values take the better side of each split.

    Trees are grown to ``depth`` by level and cut back to the ``most_leaves`` that best-first growth would make, which
    is the same tree, as a node's best split depends on its own rows alone.
    """
    edges, n = quantile_edges(df, features), len(features)
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    row = df.agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col(label)).alias("p")).first()
    if not row.n:
        return Ensemble(features, edges, [], "boosting")
    share = min(max(row.p / row.w, 1e-9), 1 - 1e-9)
    base, done = float(np.log(share / (1 - share))), []
    parts, how = partitions or -(-row.n // ROWS_A_PARTITION), Boosting(depth, most_leaves, rate, l2, min_rows)
    with Written(df.sparkSession, "boosting") as files:
        rows = files.write("rows0", binned(df, features, edges, {"y": F.col(label).cast("double"), "w": w, "score": F.lit(base)}).repartition(parts)).coalesce(parts)
        for k in range(0, rounds, settle):
            count = min(settle, rounds - k)

            def inside(batches, count=count):
                held = list(batches)
                block, trees = _block(held, n), []
                for _ in range(count):
                    trees.append(how.tree(lambda level: level.within(block), trees, n))
                yield from _tree_rows(dict(enumerate(trees))).to_batches()

            if parts == 1:
                trees = list(_trees_of(rows.mapInArrow(inside, TREES).toArrow()).values())
            else:
                trees = []
                for _ in range(count):
                    trees.append(how.tree(lambda level: run_level(rows, level, n), trees, n))
            done += trees
            if k + settle < rounds:
                rows = files.write(f"rows{k + settle}", _scored(rows, [t.packed() for t in trees], n)).coalesce(parts)
                files.drop(f"rows{k}")
    return Ensemble(features, edges, done, "boosting", base)


def _best_first(full: Tree, gain: dict[int, float], stats: dict[int, np.ndarray], most: int, value: Callable) -> Tree:
    """The part of a tree that splitting the leaf of greatest gain, again and again, gives; leaves get their values."""
    out, of = Tree(), {0: 0}
    open_nodes = {0} if 0 in gain else set()
    n = 1
    while open_nodes and n < most:
        node = max(open_nodes, key=lambda x: (gain[x], -x))
        open_nodes.remove(node)
        a, b = out.split(of[node], full.feature[node], full.bin[node], full.missing_left[node])
        for child, new in ((full.left[node], a), (full.right[node], b)):
            of[child] = new
            if child in gain:
                open_nodes.add(child)
        n += 1
    for old, new in of.items():
        if out.feature[new] < 0:
            out.value[new] = value(stats[old])
    return out


def _scored(rows: DataFrame, trees: list[tuple[np.ndarray, ...]], n_features: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if len(batch):
                block = _block([batch], n_features)
                score = block["score"].copy()
                for t in trees:
                    score += t[5][leaves(t, block["bins"])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=batch.schema.names)

    return rows.select("bins", "y", "w", "score").mapInArrow(run, "bins binary, y double, w double, score double")


@dataclass
class Forest:
    """How the trees of a forest are grown: all of them level by level."""

    tries: int
    depth: int
    seed: int

    def trees(self, split_level: Callable, numbers: list[int], n_features: int) -> dict[int, Tree]:
        seed, m = self.seed, self.tries
        forest = {t: Tree() for t in numbers}
        nodes: dict[int, list[int]] = {t: [0] for t in numbers}
        order = {(t, 0): _order(seed, t, 0, n_features) for t in numbers}
        tried, deep = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
        weights: dict[int, np.ndarray] = {}

        def counts(block, t):
            times = bootstrap_counts(block["row"], t, seed)
            drawn = np.flatnonzero(times)
            return drawn, np.stack([times[drawn] * (block["y"][drawn] != 1), times[drawn] * (block["y"][drawn] == 1)], axis=1).astype(float)

        while live := [t for t in numbers if nodes[t]]:
            slots = {t: np.array([_slice(order[t, x], tried[t, x], m) for x in nodes[t]]) for t in live}
            gains = {t: (lambda total, left, w=weights.get(t): gini_gain(total, left, _balance(total.reshape(-1, 2)[0]) if w is None else w)) for t in live}
            found = split_level(Level({t: forest[t].packed() for t in live}, {t: np.array(nodes[t]) for t in live}, slots, counts, gains))
            for t in live:
                opened, tree = [], forest[t]
                for i, node in enumerate(nodes[t]):
                    if t not in found:  # an empty sample
                        tree.value[node] = 0.5
                        continue
                    gain, feature, cut, missing_left, left, total = _choose(found[t], slots[t], i)
                    weight = weights.setdefault(t, _balance(total))
                    if not node:
                        tree.value[0] = _share(total, weight)
                    if np.isfinite(gain) and (total > 0).all():
                        a, b = tree.split(node, feature, cut, missing_left)
                        for child, s in ((a, left), (b, total - left)):
                            tree.value[child], deep[t, child] = _share(s, weight), deep[t, node] + 1
                            if (s > 0).all() and deep[t, child] < self.depth:
                                order[t, child], tried[t, child] = _order(seed, t, child, n_features), 0
                                opened.append(child)
                    elif (total > 0).all() and tried[t, node] + m < n_features:
                        tried[t, node] += m
                        opened.append(node)
                nodes[t] = opened
        return forest


def fit_forest(df: DataFrame, features: list[str], key: list[str], label: str = "y", trees: int = 600, depth: int = 32, tries: int | None = None, seed: int = 42, copies: int = 32, partitions: int | None = None) -> Ensemble:
    """Trees on Poisson bootstrap samples whose classes weigh the same within each tree; a leaf's value is its weighted share of ones.

    key: the columns that name a row, by which its counts are drawn.  Each node tries ``tries`` random features (the
    square root of all), and further ones where these don't part its rows.  The rows of a one-partition table are
    copied to ``copies`` tasks, each of which grows its share of the trees.
    """
    edges, n, count = quantile_edges(df, features), len(features), df.count()
    if not count:
        return Ensemble(features, edges, [], "forest")
    parts, how = partitions or -(-count // ROWS_A_PARTITION), Forest(tries or max(1, int(n**0.5)), depth, seed)
    with Written(df.sparkSession, "forest") as files:
        rows = files.write("rows", binned(df, features, edges, {"row": F.xxhash64(*key), "y": F.col(label).cast("double")}).repartition(parts)).coalesce(parts)
        if parts > 1:
            return Ensemble(features, edges, list(how.trees(lambda level: run_level(rows, level, n), list(range(trees)), n).values()), "forest")
        shares = min(copies, trees)

        def inside(batches):
            held = list(batches)
            if not held:
                return
            table = pa.Table.from_batches(held)
            for share in table["copy"].unique().to_pylist():
                block = _block(table.filter(pa.compute.equal(table["copy"], share)).to_batches(), n)
                yield from _tree_rows(how.trees(lambda level, block=block: level.within(block), list(range(share, trees, shares)), n)).to_batches()

        copied = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartitionByRange(shares, "copy")
        return Ensemble(features, edges, list(_trees_of(copied.mapInArrow(inside, TREES).toArrow()).values()), "forest")


def _share(counts: np.ndarray, weight: np.ndarray) -> float:
    """The weighted share of ones."""
    weighed = counts * weight
    return float(weighed[1] / weighed.sum()) if weighed.sum() else 0.5


def _balance(counts: np.ndarray) -> np.ndarray:
    """Weights that make both classes of a sample weigh half of it."""
    return counts.sum() / (2 * np.maximum(counts, 1.0))


def _order(seed: int, tree: int, node: int, n: int) -> np.ndarray:
    """A node's features in random order, by a hash of seed, tree and node."""
    with np.errstate(over="ignore"):
        start = mix(np.array([seed], dtype=np.uint64)) ^ mix(np.array([(tree << 32) + node + 1], dtype=np.uint64))
        return np.argsort(mix(start + np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)), kind="stable")


def _slice(order: np.ndarray, at: int, m: int) -> np.ndarray:
    """The next m features; the last slice is filled up from the front."""
    return np.take(order, np.arange(at, at + m), mode="wrap")
