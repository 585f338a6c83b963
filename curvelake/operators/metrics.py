"""Classification metrics, class weights, group splits and bootstrap summaries as aggregates."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, by: list[str], label: str = "y", predicted: str = "predicted") -> DataFrame:
    both = [("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)]
    return df.groupBy(*by).agg(*(F.count(F.when((F.col(label) == y) & (F.col(predicted) == p), 1)).alias(n) for n, y, p in both), F.count("*").alias("n"))


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, precision = _ratio(tp, tp + fn), _ratio(tp, tp + fp)
    both = (tp + fn > 0) & (tn + fp > 0)
    balanced = F.when(both, (recall + _ratio(tn, tn + fp)) / 2).otherwise(F.greatest(recall, _ratio(tn, tn + fp)))
    return counts.select("*", balanced.alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def metrics_by_slice(df: DataFrame, slices: list[str], least: int = 5) -> DataFrame:
    """Overall and per value of each slice column (GROUPING SETS, one pass); slices under ``least`` rows go."""
    sets = ", ".join(["()", *(f"(`{s}`)" for s in slices)])
    which = "coalesce(" + ", ".join([f"if(grouping(`{s}`) = 0, '{s}', null)" for s in slices] + ["'overall'"]) + ")"
    value = "coalesce(" + ", ".join([f"if(grouping(`{s}`) = 0, coalesce(cast(`{s}` as string), 'null'), null)" for s in slices] + ["'all'"]) + ")"
    counts = df.sparkSession.sql(f"""
        select {which} as slice, {value} as slice_value, count_if(y = 1 and predicted = 1) as tp, count_if(y = 0 and predicted = 1) as fp,
               count_if(y = 1 and predicted = 0) as fn, count_if(y = 0 and predicted = 0) as tn, count(*) as n
        from {{rows}} group by grouping sets ({sets}) having count(*) >= {least}""", rows=df)
    return with_rates(counts)


def _at_score(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Positives and rows per distinct score: what ranks need, pre-aggregated, so ties never meet in one task."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))


_MOST_RANGES = 4096


def _range_of(column: str, cuts: list[float]) -> Column:
    """How many of the sorted cuts lie below a value, by bisection."""
    if not cuts:
        return F.lit(0)
    edges = F.array(*(F.lit(float(c)) for c in cuts))
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.col(column) > F.get(edges, at + step - 1), at + step).otherwise(at))


def _cumulated(t: DataFrame, by: list[str], falling: bool, held: int = 1 << 20) -> DataFrame:
    """t (a row per ``by`` and score) with pos_before, n_before: sums over the rows before each one.

    Scores are cut at quantiles into ranges of about ``held`` rows (64 ranges at least, ``_MOST_RANGES`` driver values at
    most), so no task sees all scores of a group: sums within a range, then the sums of the ranges before it.
    """
    fine = [k / _MOST_RANGES for k in range(1, _MOST_RANGES)]
    found = t.agg(F.count("s").alias("n"), F.percentile_approx("s", fine, 10 * _MOST_RANGES).alias("cuts")).first()
    parts = min(_MOST_RANGES, max(64, 1 << (found.n // held).bit_length()))
    cuts = sorted(set((found.cuts or [])[_MOST_RANGES // parts - 1 :: _MOST_RANGES // parts]))
    part = _range_of("s", cuts)
    t = t.withColumn("part", -part if falling else part)
    order = F.col("s").desc() if falling else F.col("s").asc()
    inside = Window.partitionBy(*by, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows a group
    ranges = t.groupBy(*by, "part").agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))
    ranges = ranges.select(*by, "part", F.coalesce(F.sum("p").over(over), F.lit(0)).alias("p_before"), F.coalesce(F.sum("m").over(over), F.lit(0)).alias("m_before"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "part")]
    own = t.select("*", F.coalesce(F.sum("pos").over(inside), F.lit(0)).alias("pos_in"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n_in"))
    joined = own.alias("t").join(ranges.alias("r"), reduce(lambda a, b: a & b, same))
    return joined.select(*(f"t.{c}" for c in t.columns), (F.col("pos_in") + F.col("p_before")).alias("pos_before"), (F.col("n_in") + F.col("m_before")).alias("n_before"))


def roc_auc(df: DataFrame, by: list[str] | None = None, label: str = "y", score: str = "p") -> DataFrame:
    """Mann-Whitney form with mid-ranks; NULL where one class is missing."""
    by = by or []
    t = _cumulated(_at_score(df, by, label, score), by, falling=False).withColumn("below", F.col("n_before") - F.col("pos_before"))
    won = F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2.0))
    pairs = F.sum("pos") * (F.sum("n") - F.sum("pos"))
    return t.groupBy(*by).agg((won / F.nullif(pairs, F.lit(0))).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str] | None = None, label: str = "y", score: str = "p") -> DataFrame:
    """Sum of precision times the gain in recall over falling distinct scores; NULL where one class is missing."""
    by = by or []
    t = _cumulated(_at_score(df, by, label, score), by, falling=True).select("*", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("n_before") + F.col("n")).alias("k"))
    return t.groupBy(*by).agg(F.when((F.sum("pos") > 0) & (F.sum("pos") < F.sum("n")), F.sum(F.col("pos") * F.col("tp") / F.col("k")) / F.sum("pos")).alias("average_precision"))


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """label, n, weight = rows / (classes * n)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k")).first()
    return counts.withColumn("weight", F.lit(float(total.t or 0)) / (F.lit(float(total.k or 1)) * F.col("n")))


_HASH_BITS = 60


def _kth(hashes: DataFrame, k: int, held: int = 10_000) -> int:
    """The k-th smallest of distinct whole numbers under 2**60: counts by range, narrowed to the range that holds it; -1 for k = 0."""
    low, bits = 0, _HASH_BITS
    while k:
        bits = max(bits - 12, 0)
        ranges = hashes.where(F.col("h").between(low, low + (1 << min(bits + 12, _HASH_BITS)) - 1)).groupBy(F.shiftright(F.col("h") - low, bits).alias("r")).agg(F.count("*").alias("n"))
        for r, n in sorted(map(tuple, ranges.collect())):  # 4,096 at most
            if k <= n:
                break
            k -= n
        low += r << bits
        if n <= held or not bits:
            inside = hashes.where(F.col("h").between(low, low + (1 << bits) - 1)).select("h").toArrow()["h"].to_pylist()
            return sorted(inside)[k - 1]
    return -1


def group_split(df: DataFrame, group: str, seed: int = 42, test: float = 0.2, val: float = 0.25) -> DataFrame:
    """Adds split: each group whole in train, val or test; ceil(test * groups) are in test, ceil(val * the others) in val.

    Groups stand in the order of a hash of seed and group.  The two cuts of that order are found by counts of ranges,
    so no groups are sorted in one place and the counts are exact however rows are partitioned.  Null is a group.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")).cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("long")
    hashes = df.select(h.alias("h")).distinct()
    n = hashes.count()
    n_test = ceil(round(test * n, 9))
    n_val = ceil(round(val * (n - n_test), 9))
    first, second = _kth(hashes, n_test), _kth(hashes, n_test + n_val)
    return df.withColumn("split", F.when(h <= first, "test").when(h <= second, "val").otherwise("train"))


def leaking_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return df.groupBy(group).agg(F.countDistinct("split").alias("n")).where("n > 1").select(group)


def stability(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, least and largest value by model and metric."""
    long = runs.unpivot(["model"], metrics, "metric", "value")
    return long.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def bootstrap_summary(samples: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Mean, deviation and exact quantiles of replicates."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2), F.lit(0.05), F.lit(0.95)))
    return samples.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), q.alias("_q")).select(*keys, "n", "mean", "sd", *(F.get("_q", i).alias(n) for i, n in enumerate(("ci_lo", "ci_hi", "q05", "q95"))))


def resampled_means(points: DataFrame, key: str, index: str, value: str, replicates: int, seed: int = 42) -> DataFrame:
    """(key, replicate, m): means of hash-seeded draws with replacement, as many a replicate as the key has rows.

    points has a dense 0-based ``index`` per key; draws depend on seed, key, replicate and draw alone.  A key's values
    become one row and its draws are made and summed up beside it, in one pass: no table of draws is shuffled, and none
    is broadcast, for which the planner, that doesn't count what explode makes, would take it to be small.
    """
    rows = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))).alias("_at"))
    rows = rows.select(key, F.col("_at.v").alias("_v"), F.size("_at").alias("_n"))
    draws = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("replicate").cast("string"), F.col("draw").cast("string")).cast("binary"))
    picked = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("_n")).cast("int")
    return draws.groupBy(key, "replicate").agg(F.avg(F.get("_v", picked)).alias("m"))
