"""Baseline, smoothing and normalisation of curves on their observed points (curve_key, time_h, od)."""

from __future__ import annotations

from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelake.operators.grid import KEY

def by_time():
    return Window.partitionBy(KEY).orderBy("time_h")


def whole():
    return Window.partitionBy(KEY)


def observed(grid: DataFrame) -> DataFrame:
    return grid.where("od is not null")


def baseline_correct(points: DataFrame, clip: bool = True, blank: float | None = None, first: int = 5) -> DataFrame:
    """Subtracts a blank value, else the median of the first points by time."""
    if blank is not None:
        base = F.lit(float(blank))
        ranked = points
    else:
        ranked = points.withColumn("_n", F.row_number().over(by_time()))
        base = F.percentile(F.when(F.col("_n") <= first, F.col("od")), 0.5).over(whole())
    value = F.col("od") - base
    return ranked.withColumn("od", F.greatest(value, F.lit(0.0)) if clip else value).drop("_n")


def baseline_by_file(points: DataFrame, blanks: DataFrame, clip: bool = True) -> DataFrame:
    """points with file_name; blanks (file_name, status RAW or ALREADY, blank_value): ALREADY stays as it is."""
    joined = points.join(blanks.select("file_name", "status", "blank_value"), "file_name", "left")
    ranked = joined.withColumn("_n", F.row_number().over(by_time()))
    own = F.percentile(F.when(F.col("_n") <= 5, F.col("od")), 0.5).over(whole())
    value = F.when(F.col("status") == "ALREADY", F.col("od")).otherwise(F.col("od") - F.coalesce("blank_value", own))
    return ranked.withColumn("od", F.greatest(value, F.lit(0.0)) if clip else value).drop("_n", "status", "blank_value")


def rolling_smooth(points: DataFrame, window: int = 5) -> DataFrame:
    """Mean over a centred window that counts what lies beyond the ends as zero; short curves stay."""
    half = window // 2
    total = F.sum("od").over(by_time().rowsBetween(-half, window - 1 - half))
    return points.withColumn("od", F.when(F.count("od").over(whole()) < window, F.col("od")).otherwise(total / window))


def savgol_parts(window: int, at: int, order: int = 2) -> tuple[list[int], int]:
    """Whole numbers and their common divisor: what each of ``window`` points adds to the value at place ``at`` of the least-squares polynomial through them."""
    powers = [[Fraction(x - at) ** k for k in range(order + 1)] for x in range(window)]
    rows = [[sum(p[i] * p[j] for p in powers) for j in range(order + 1)] + [Fraction(i == 0)] for i in range(order + 1)]
    for i in range(order + 1):  # the normal equations are positive definite: no pivots
        rows[i] = [v / rows[i][i] for v in rows[i]]
        rows = [r if k == i else [v - r[i] * w for v, w in zip(r, rows[i], strict=True)] for k, r in enumerate(rows)]
    weights = [sum(r[-1] * v for r, v in zip(rows, p, strict=True)) for p in powers]
    whole = lcm(*(w.denominator for w in weights))
    return [int(w * whole) for w in weights], whole


def savgol_weights(window: int, at: int, order: int = 2) -> list[float]:
    parts, whole = savgol_parts(window, at, order)
    return [w / whole for w in parts]


def savgol_smooth(points: DataFrame, window: int = 5) -> DataFrame:
    """Order 2 over an odd window (the next one if even; under 3 nothing is smoothed); the ends follow the parabola of the outermost points.

    Curves of fewer points than the window stay.  Whole weights are divided once, from the nearer end on, so points on a
    straight line get the same last bits whoever computes them: steps that tie there decide where a slope is largest.
    """
    if window < 3:
        return points
    window += 1 - window % 2
    half = window // 2
    n, i = F.count("od").over(whole()), F.row_number().over(by_time())
    places = {o: F.lag("od", -o).over(by_time()) if o < 0 else F.lead("od", o).over(by_time()) if o > 0 else F.col("od") for o in range(1 - window, window)}

    def combine(at: int, side: int = 1):
        parts, whole = savgol_parts(window, at)
        return sum((F.lit(float(w)) * places[side * (k - at)] for k, w in enumerate(parts)), F.lit(0.0)) / float(whole)

    value = F.when(n < window, F.col("od"))
    for at in range(half):
        value = value.when(i == at + 1, combine(at)).when(i == n - at, combine(at, -1))
    return points.withColumn("od", value.otherwise(combine(half)))


def lowess_smooth(points: DataFrame, window: int = 5) -> DataFrame:
    """Robust local regression per curve; fewer than 6 points stay."""
    from curvelake.kernels.lowess import lowess
    from curvelake.operators.fit import packed

    def run(batches):
        for batch in batches:
            smoothed = []
            for t, y in zip(batch.column(1), batch.column(2), strict=True):
                t, y = t.values.to_numpy(), y.values.to_numpy()
                smoothed.append(lowess(t, y, float(np.clip(window / len(y), 0.2, 1.0))) if len(y) >= 6 else y)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(smoothed, pa.list_(pa.float64()))], names=batch.schema.names)

    rows = packed(points, 0.003).mapInArrow(run, f"{KEY} string, time_h array<double>, od array<double>")
    return rows.select(KEY, F.explode(F.arrays_zip("time_h", "od")).alias("p")).select(KEY, "p.time_h", "p.od")


def smooth(points: DataFrame, method: str = "SGF", window: int = 5) -> DataFrame:
    chosen = {"NONE": lambda p: p, "RAW": lambda p: rolling_smooth(p, window), "RAV": lambda p: rolling_smooth(p, window), "SGF": lambda p: savgol_smooth(p, window), "LWS": lambda p: lowess_smooth(p, window)}
    return chosen[method.upper()](points)


def normalize(points: DataFrame, mode: str = "MINMAX") -> DataFrame:
    """NONE, MAX (by a positive maximum) or MINMAX (flat curves become 0)."""
    hi, lo, size = F.max("od").over(whole()), F.min("od").over(whole()), F.max(F.abs("od")).over(whole())
    value = {
        "NONE": F.col("od"),
        "MAX": F.when(hi > 0, F.col("od") / hi).otherwise(F.col("od")),
        "MINMAX": F.when(hi - lo <= 1e-9 * size, 0.0).otherwise((F.col("od") - lo) / (hi - lo)),
    }[mode.upper()]
    return points.withColumn("od", value)


def preprocess(grid: DataFrame, baseline: bool = False, method: str = "SGF", mode: str = "MINMAX", window: int = 5) -> DataFrame:
    """Baseline, then smoothing, then normalisation, on the grid points that have a value."""
    points = observed(grid).select(KEY, "time_h", "od")
    points = baseline_correct(points) if baseline else points
    return normalize(smooth(points, method, window), mode)
