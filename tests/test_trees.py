"""Tree ensembles against plain loops, over several partitions, with missing values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvelake.ml import trees as T
from curvelake.operators import labels, metrics

FEATURES = ["a", "b", "c"]


def fixture(spark, n=140, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=n) * 0.4 > 0).astype(float)
    x[rng.random((n, 3)) < 0.15] = np.nan
    rows = [(i, *(None if math.isnan(v) else float(v) for v in x[i]), float(y[i]), float(1 + i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, w double"), rows


def plain_boosting(rows, edges, rounds, depth, rate, l2, min_rows, most_leaves):
    """Every node, feature, cut and side of nulls in turn; leaves split best first."""
    bins = [[T.MISSING if v is None else sum(v > e for e in edges[k]) for k, v in enumerate(r[1:4])] for r in rows]
    y, w = [r[4] for r in rows], [r[5] for r in rows]
    share = sum(a * b for a, b in zip(y, w, strict=True)) / sum(w)
    score = [math.log(share / (1 - share))] * len(rows)
    unit = 2.0**24
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [round(w[i] * (y[i] - p[i]) * unit) for i in range(len(rows))]
        h = [round(w[i] * p[i] * (1 - p[i]) * unit) for i in range(len(rows))]
        value = lambda s: (sum(g[i] for i in s) / unit) ** 2 / max(sum(h[i] for i in s) / unit + l2, 1e-12)

        def best(s, g=g, h=h, value=value):
            top = (0.0, None)
            for k in range(3):
                null = [i for i in s if bins[i][k] == T.MISSING]
                for cut in range(T.MISSING):
                    left = [i for i in s if bins[i][k] <= cut and bins[i][k] != T.MISSING]
                    for side in (False, True) if null else (False,):
                        one = left + null if side else left
                        two = [i for i in s if i not in set(one)]
                        if min(len(one), len(two)) < min_rows or min(sum(h[i] for i in one), sum(h[i] for i in two)) < 1e-3 * unit:
                            continue
                        gain = value(one) + value(two) - value(s)
                        if gain > top[0] + 1e-12:
                            top = (gain, (one, two))
                    if not [i for i in s if cut < bins[i][k] < T.MISSING]:
                        break
            return top

        leaves = [(list(range(len(rows))), 0, *best(range(len(rows))))]
        while len(leaves) < most_leaves:
            able = [x for x in leaves if x[3] and x[1] < depth]
            if not able:
                break
            chosen = max(able, key=lambda x: x[2])
            leaves.remove(chosen)
            leaves += [(s, chosen[1] + 1, *best(s)) for s in chosen[3]]
        for s, *_ in leaves:
            step = rate * sum(g[i] for i in s) / max(sum(h[i] for i in s) + l2 * unit, 1e-12)
            for i in s:
                score[i] += step
    return [1 / (1 + math.exp(-s)) for s in score]


@pytest.mark.parametrize("partitions", [1, 3])
@pytest.mark.parametrize("options", [{"rounds": 3, "depth": 3, "l2": 0.0, "most_leaves": 31}, {"rounds": 3, "depth": 4, "l2": 1.5, "most_leaves": 5}])
def test_boosting_equals_plain_loops(spark, partitions, options):
    df, rows = fixture(spark)
    model = T.fit_boosting(df, FEATURES, weight="w", rate=0.3, min_rows=5, settle=2, partitions=partitions, **options)
    want = plain_boosting(rows, model.edges, rate=0.3, min_rows=5, **options)
    got = {r.id: r.p for r in df.select("id", model.probability().alias("p")).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=1e-9)
    assert all(sum(f < 0 for f in t.feature) <= options["most_leaves"] for t in model.trees) and len(model.trees) == 3


def test_boosting_learns_where_nulls_go(spark):
    """Nulls of a feature are the positives: one split of one tree finds them; later nulls of another go to the larger side."""
    df = spark.range(200).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") % 7).cast("double")).alias("a"), F.lit(1.0).alias("b"), (F.col("id") % 4 == 0).cast("double").alias("y"))
    model = T.fit_boosting(df, ["a", "b"], rounds=1, depth=1, rate=1.0)
    p = df.withColumn("p", model.probability()).groupBy("y").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    by = {r.y: (r.lo, r.hi) for r in p}
    assert by[1.0][0] > 0.5 > by[0.0][1]


def test_bootstrap_weights_per_tree():
    """Counts are Poisson of mean one, differ by tree, follow the row alone; classes weigh the same in each tree."""
    rows = np.random.default_rng(0).integers(-(2**62), 2**62, 40_000)
    one, two = (T.bootstrap_counts(rows, t, 42) for t in (0, 1))
    for counts in (one, two):
        assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.04 and abs((counts == 0).mean() - math.exp(-1)) < 0.01
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.02
    assert (T.bootstrap_counts(rows[::-1], 0, 42) == one[::-1]).all() and (T.bootstrap_counts(rows, 0, 43) != one).any()
    counts = np.array([300.0, 20.0])
    assert (counts * T._balance(counts)).tolist() == [160.0, 160.0]


@pytest.mark.parametrize("partitions", [1, 3])
def test_forest_equals_plain_loops(spark, partitions):
    """Each tree by itself, rows in lists: samples, balanced weights, features of each node, cuts and leaves."""
    df, rows = fixture(spark, 90)
    df = df.fillna(0.0, FEATURES)
    model = T.fit_forest(df, FEATURES, ["id"], trees=7, depth=5, tries=2, seed=11, copies=3, partitions=partitions)
    ids = np.array([r.h for r in df.orderBy("id").select(F.xxhash64("id").alias("h")).collect()])
    bins = [[sum((0.0 if v is None else v) > e for e in model.edges[k]) for k, v in enumerate(r[1:4])] for r in rows]
    total = np.zeros(len(rows))
    for t in range(7):
        times = T.bootstrap_counts(ids, t, 11)
        count = lambda s, times=times: [sum(times[i] for i in s if rows[i][4] == y) for y in (0.0, 1.0)]
        weight = [sum(count(range(len(rows)))) / (2 * max(c, 1)) for c in count(range(len(rows)))]

        def purity(s, count=count, weight=weight):
            w = [a * b for a, b in zip(count(s), weight, strict=True)]
            return sum(x * x for x in w) / max(sum(w), 1e-300)

        tree, node_of, members = model.trees[t], {0: 0}, {0: list(range(len(rows)))}
        queue = [(0, 0)]
        while queue:
            node, deep = queue.pop()
            s = members[node]
            if tree.feature[node] < 0:
                w = [a * b for a, b in zip(count(s), weight, strict=True)]
                assert tree.value[node] == pytest.approx(w[1] / sum(w))
                for i in s:
                    total[i] += tree.value[node]
                gains = [purity([i for i in s if bins[i][k] <= c]) + purity([i for i in s if bins[i][k] > c]) for k in range(3) for c in range(50) if all(sum(count([i for i in s if (bins[i][k] <= c) == side])) for side in (True, False))]
                assert deep == 5 or min(count(s)) == 0 or not gains
                continue
            order = T._order(11, t, node, 3).tolist()
            found = {}
            for k in range(3):
                options = [(purity([i for i in s if bins[i][k] <= c]) + purity([i for i in s if bins[i][k] > c]), -c) for c in range(50) if all(sum(count([i for i in s if (bins[i][k] <= c) == side])) for side in (True, False))]
                if options:
                    found[k] = max(options)
            tried = [k for k in order[:2] if k in found] or [k for k in order if k in found]
            k = tree.feature[node]
            assert k in tried and found[k][0] == pytest.approx(max(found[x][0] for x in tried))
            here = purity([i for i in s if bins[i][k] <= tree.bin[node]]) + purity([i for i in s if bins[i][k] > tree.bin[node]])
            assert here == pytest.approx(found[k][0])
            members[tree.left[node]] = [i for i in s if bins[i][k] <= tree.bin[node]]
            members[tree.right[node]] = [i for i in s if bins[i][k] > tree.bin[node]]
            queue += [(tree.left[node], deep + 1), (tree.right[node], deep + 1)]
    got = {r.id: r.p for r in df.select("id", model.probability().alias("p")).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx((total / 7).tolist(), abs=1e-9)


def test_partitions_change_nothing(spark):
    df, _ = fixture(spark, 400, 8)
    boosted = [T.fit_boosting(df.repartition(k), FEATURES, rounds=4, depth=4, partitions=p).trees for k, p in ((1, 1), (5, 4))]
    filled = df.fillna(0.0, FEATURES)
    forests = [T.fit_forest(filled.repartition(k), FEATURES, ["id"], trees=6, partitions=p).trees for k, p in ((1, 1), (5, 4))]
    assert boosted[0] == boosted[1] and forests[0] == forests[1]


def test_save_load_and_empty(spark, tmp_path):
    df, _ = fixture(spark)
    model = T.fit_boosting(df, FEATURES, rounds=2)
    model.save(spark, f"file://{tmp_path}/m")
    assert T.Ensemble.load(spark, f"file://{tmp_path}/m") == model
    none = df.where("false")
    assert T.fit_boosting(none, FEATURES).trees == [] and T.fit_forest(none, FEATURES, ["id"]).trees == []
    assert isinstance(df.select(model.probability().alias("p")).toPandas(), pd.DataFrame)


@pytest.mark.parametrize("falling", [False, True])
def test_sums_before_over_many_ranges(spark, falling):
    """More ranges than 64, ties of groups, a group of one row and a null group against plain sums."""
    rng = np.random.default_rng(5)
    drawn = {(g, round(float(s), 3)) for g, n in (("a", 900), ("b", 40), (None, 7), ("c", 1)) for s in rng.normal(size=n)}
    rows = [(g, s, int(rng.integers(0, 4)), int(rng.integers(4, 9))) for g, s in sorted(drawn, key=str)]
    table = spark.createDataFrame(rows, "g string, s double, pos long, n long")
    got = metrics._cumulated(table, ["g"], falling, held=4)
    before = lambda g, s, k: sum(r[k] for r in rows if r[0] == g and (r[1] > s if falling else r[1] < s))
    assert sorted(((r.g, r.s, r.pos_before, r.n_before) for r in got.collect()), key=str) == sorted(((g, s, before(g, s, 2), before(g, s, 3)) for g, s, _, _ in rows), key=str)
    assert got.select("part").distinct().count() > 64


def test_range_of_a_value(spark):
    cuts = [-1.0, 0.0, 0.5, 2.0, 7.0]
    values = [-5.0, -1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 2.0, 3.0, 7.0, 8.0]
    table = spark.createDataFrame([(v,) for v in values], "s double")
    for k in range(len(cuts) + 1):
        assert [r[0] for r in table.select(metrics._range_of("s", cuts[:k])).collect()] == [sum(v > c for c in cuts[:k]) for v in values]


def test_review_curves(spark):
    out = spark.createDataFrame([("x[conc=0.5]", "Valid", 0.9, 0), ("y", "Invalid", 0.8, 1), ("y", "Valid", 0.7, 1), (None, "Valid", 0.6, 0)], "curve_key string, pred_label string, pred_confidence double, too_sparse int")
    review = spark.createDataFrame([("x[conc=0.5]", "Unsure", "Invalid"), ("y", None, "Valid"), ("z", None, None), (None, None, None)], "curve_key string, pred_label string, true_label string")
    got = sorted(map(tuple, labels.review_curves(out, review).select("curve_key", "pred_label", "true_label", "pred_confidence", "too_sparse", "concentration").collect()), key=str)
    assert got == [("x[conc=0.5]", "Unsure", "Invalid", 0.9, 0, 0.5), ("y", None, "Valid", 0.7, 1, None), ("z", None, None, None, None, None), (None, None, None, None, None, None)]
    assert labels.review_curves(out).count() == 4 and labels.review_curves(out.limit(0), review).count() == 4 and labels.review_curves(out, review.limit(0)).count() == 0
    assert labels.review_curves(out.select("curve_key"), review.withColumn("concentration", F.lit(3.0))).first().concentration == 3.0
