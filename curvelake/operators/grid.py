"""Point statistics and resampling of curves.

Curves are long: (curve_key, time_h, od).  One shuffle on curve_key serves all windows of an operator.
NULL stands for a missing value throughout; NaN and infinities are turned to NULL at the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelake.config import GridConfig

KEY = "curve_key"


def half_even(x):
    return F.bround(x, 0)


def dedupe_mean(obs: DataFrame, keys: list[str] | None = None, count: str | None = None) -> DataFrame:
    """One row per curve and time: the mean of what was measured then, and, under the name ``count``, how often."""
    keys = keys or [KEY, "time_h"]
    return obs.where("time_h is not null and od is not null").groupBy(*keys).agg(F.avg("od").alias("od"), *([F.count("*").alias(count)] if count else []))


def point_stats(obs: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Per curve: n_points, max_gap, span, expected grid points, missing fraction, too_sparse."""
    w = Window.partitionBy(KEY).orderBy("time_h")
    gaps = obs.where("time_h is not null and od is not null").select(KEY, "time_h", (F.col("time_h") - F.lag("time_h").over(w)).alias("gap"))
    per = gaps.groupBy(KEY).agg(F.count("*").alias("n_points"), F.max("gap").alias("max_gap"), (F.max("time_h") - F.min("time_h")).alias("span"))
    expected = (half_even(F.col("span") / cfg.step) + 1).cast("long")
    missing = F.when(F.col("n_points") == 1, 0.0).otherwise(F.greatest(F.lit(0), expected - F.col("n_points")) / expected)
    return per.select(KEY, "n_points", "max_gap", "span", expected.alias("expected"), missing.alias("missing_frac"), (F.col("n_points") < cfg.min_points).alias("too_sparse"))


def grid_interpolate(obs: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """(curve_key, grid_ix, time_h, od): linear between neighbours, NULL outside the observed span.

    Grid rows are exploded per curve and merged with the points in one window pass; neighbours are the last
    point at or before and the first at or after each grid time.  Curves of one point are all NULL.
    """
    points = dedupe_mean(obs)
    curves = obs.select(KEY).distinct()
    grid = curves.withColumn("grid_ix", F.explode(F.sequence(F.lit(0), F.lit(cfg.points - 1)))).withColumn("time_h", F.col("grid_ix") * F.lit(cfg.step))
    rows = points.select(KEY, "time_h", "od", F.lit(None).cast("int").alias("grid_ix")).unionByName(grid.withColumn("od", F.lit(None).cast("double")))
    here = F.when(F.col("grid_ix").isNull(), F.struct(F.col("time_h").alias("t"), F.col("od").alias("y")))
    back = Window.partitionBy(KEY).orderBy("time_h", F.col("grid_ix").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(KEY).orderBy(F.col("time_h").desc(), F.col("grid_ix").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(KEY)
    near = rows.select(KEY, "grid_ix", "time_h", F.last(here, True).over(back).alias("a"), F.last(here, True).over(ahead).alias("b"), F.count("od").over(whole).alias("n"))
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.t") - F.col("a.t"))
    value = F.when((F.col("n") < 2) | F.col("a").isNull() | F.col("b").isNull(), None).when(F.col("b.t") == F.col("a.t"), F.col("a.y")).otherwise(F.col("a.y") + slope * (F.col("time_h") - F.col("a.t")))
    return near.where("grid_ix is not null").select(KEY, "grid_ix", "time_h", value.alias("od"))


def raw_merged(obs: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """The grid with each curve's point statistics; curves that are too sparse keep rows without values."""
    stats = point_stats(obs, cfg)
    grid = grid_interpolate(obs, cfg).join(stats, KEY, "left")
    return grid.withColumn("od", F.when(F.coalesce("too_sparse", F.lit(True)), None).otherwise(F.col("od")))


def grid_missing(grid: DataFrame) -> DataFrame:
    """Per curve the grid rows with and without a value."""
    return grid.groupBy(KEY).agg(F.count("od").alias("n_filled"), F.count(F.when(F.col("od").isNull(), 1)).alias("n_missing"))


def split_windows(obs: DataFrame, start: float = 16.0) -> tuple[DataFrame, DataFrame]:
    """Early (time <= start) and late points."""
    return obs.where(F.col("time_h") <= start), obs.where(F.col("time_h") > start)
