"""Shape features of preprocessed grid curves, one row per curve, in one window pass and one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelake.config import GridConfig
from curvelake.operators.grid import KEY

ROUGH = 1e-9


def _prepared(points: DataFrame) -> DataFrame:
    """Steps, positions, per-curve extremes and a rolling mean beside each point."""
    by, whole = Window.partitionBy(KEY).orderBy("time_h"), Window.partitionBy(KEY)
    p = points.where("od is not null").select(KEY, "time_h", "od")
    p = p.select("*", F.lag("time_h").over(by).alias("t0"), F.lag("od").over(by).alias("y0"), F.lead("od").over(by).alias("y1"), F.row_number().over(by).alias("i"), F.count("*").over(whole).alias("n"))
    p = p.select("*", F.min("od").over(whole).alias("lo"), F.max("od").over(whole).alias("hi"), F.first("od").over(by).alias("start"), F.min("time_h").over(whole).alias("t_first"), F.max("time_h").over(whole).alias("t_last"), (F.sum("od").over(by.rowsBetween(-2, 2)) / 5.0).alias("rolled"))
    step, dt = F.col("od") - F.col("y0"), F.col("time_h") - F.col("t0")
    p = p.select("*", step.alias("dy"), dt.alias("dt"), (step / dt).alias("slope"), F.signum(step).alias("sgn"))
    peak = F.when((F.col("i") > 1) & (F.col("i") < F.col("n")) & (F.col("od") >= F.col("y0")) & (F.col("od") >= F.col("y1")), F.col("time_h"))
    return p.select("*", F.last(F.when(F.col("sgn") != 0, F.col("sgn")), True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_sgn"), F.min(peak).over(whole).alias("peak_first"), F.max(peak).over(whole).alias("peak_last"))


def features(points: DataFrame, stats: DataFrame, grid: DataFrame | None = None, cfg: GridConfig = GridConfig(), horizon: float = 16.0) -> DataFrame:
    """points: preprocessed values; stats: point_stats of the raw curve (its counters win over the grid's).

    Curves of stats without any point keep NULL shape features.
    """
    p = _prepared(points)
    rng = F.col("hi") - F.col("lo")
    tail = F.greatest(F.lit(2), F.ceil(F.lit(0.15) * F.col("n")))
    crossing = lambda share: F.min(F.when(F.col("od") >= F.col("start") + share * rng, F.col("time_h")))
    first_at = lambda value, order: F.min_by("time_h", F.struct(-value, order))
    per = p.groupBy(KEY).agg(
        F.max("time_h").alias("observed_tmax"), F.count("*").alias("n_grid"), F.max("dt").alias("grid_gap"), F.percentile("dt", 0.5).alias("median_dt"),
        F.min_by("od", "time_h").alias("initial_OD"), F.max_by("od", "time_h").alias("final_OD"),
        F.coalesce(F.sum((F.col("od") + F.col("y0")) / 2 * F.col("dt")), F.lit(0.0)).alias("auc"),
        F.max("slope").alias("max_slope"), first_at(F.col("slope"), F.col("time_h")).alias("_slope_any"),
        F.min_by("time_h", F.when(F.col("slope").isNotNull(), F.struct(-F.col("slope"), F.col("time_h")))).alias("time_of_max_slope"),
        F.min_by("time_h", F.struct(-F.col("od"), F.col("time_h"))).alias("time_of_max_OD"),
        (F.count(F.when(F.col("dy") > 0, 1)) / F.nullif(F.count("dy"), F.lit(0))).alias("monotonicity_fraction"),
        F.min("dy").alias("worst"), F.max("hi").alias("hi"), F.max("lo").alias("lo"), F.stddev_pop("dy").alias("roughness"),
        F.stddev_pop(F.col("od") - F.col("rolled")).alias("resid"),
        F.min(F.when(F.col("od") >= F.col("start") + 0.1 * rng, F.col("time_h"))).alias("t10"), crossing(0.9).alias("t90"),
        F.percentile(F.when(F.col("i") > F.col("n") - tail, F.col("od")), 0.5).alias("plateau_OD"),
        F.count(F.when((F.col("sgn") != 0) & F.col("prev_sgn").isNotNull() & (F.col("sgn") != F.col("prev_sgn")), 1)).alias("num_slope_sign_changes"),
        F.max("peak_first").alias("peak_first"), F.max("peak_last").alias("peak_last"), F.max("t_first").alias("t_first"),
        F.max(F.when(F.col("time_h") == F.col("peak_first"), F.col("od"))).alias("od_first"), F.max(F.when(F.col("time_h") == F.col("peak_last"), F.col("od"))).alias("od_last"),
        F.min(F.when((F.col("time_h") > F.col("peak_first")) & (F.col("time_h") < F.col("peak_last")), F.col("od"))).alias("od_between"),
    ).drop("_slope_any")
    f = stats.select(KEY, "n_points", "max_gap", "missing_frac", "too_sparse").join(per, KEY, "left")
    n, span, r = F.coalesce("n_points", "n_grid"), F.col("observed_tmax"), F.col("hi") - F.col("lo")
    gap = F.coalesce("max_gap", "grid_gap")
    multi = (n >= 7) & (F.col("peak_last") > F.col("peak_first")) & (F.col("od_first") > F.col("initial_OD") + 0.2 * r) & (F.col("od_last") > F.col("initial_OD") + 0.2 * r) & (F.col("od_between") < F.col("hi") - 0.2 * r)
    return f.select(
        KEY, "observed_tmax", n.cast("long").alias("n_points_observed"), gap.alias("max_gap_hours"), F.col("missing_frac").alias("missing_frac_on_grid"), F.col("too_sparse").cast("int").alias("too_sparse"),
        ((F.coalesce("median_dt", F.lit(0.0)) > 0.5) | (F.coalesce(gap, F.lit(0.0)) > 2.0) | (F.coalesce("missing_frac", F.lit(0.0)) > 0.25)).cast("int").alias("grid_resolution_mismatch"),
        F.lit(horizon).alias("train_horizon"), (F.coalesce(span, F.lit(horizon)) < 16.0 - 1e-9).cast("int").alias("is_censored"),
        "initial_OD", "final_OD", "auc", F.when(span > 0, F.col("auc") / span).alias("auc_per_hour"), F.when(span > 0, (F.col("final_OD") - F.col("initial_OD")) / span).alias("net_change_per_hour"),
        "max_slope", "time_of_max_slope", "time_of_max_OD", "monotonicity_fraction",
        F.when(F.col("hi").isNull(), None).when((r <= ROUGH) | F.coalesce(F.col("worst") >= 0, F.lit(True)), 0.0).otherwise(F.abs("worst") / r).alias("largest_drop_frac"),
        "roughness", F.when(n >= 8, F.col("resid")).when(n >= 4, F.col("roughness") / F.sqrt(F.lit(2.0))).alias("noise_residual_std"),
        F.when(F.col("n_grid").isNull(), None).otherwise(((n >= 4) & (n < 8)).cast("int")).alias("noise_residual_std_is_fallback"),
        F.col("t10").alias("lag_time_est"), "plateau_OD", F.when(F.col("t90") >= F.col("t10"), F.col("t90") - F.col("t10")).alias("growth_phase_duration"),
        ((F.col("time_of_max_OD") - F.col("t_first")) / F.nullif(span - F.col("t_first"), F.lit(0.0))).alias("symmetry_factor"),
        F.col("num_slope_sign_changes").cast("long").alias("num_slope_sign_changes"), F.when(F.col("n_grid").isNull(), None).otherwise(F.coalesce(multi, F.lit(False)).cast("int")).alias("multi_phase_flag"),
    )
