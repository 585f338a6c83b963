"""Late-window evidence of raw curves: growth, artifacts, decline, data quality, and the checker's status."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from curvelake.config import LateConfig
from curvelake.kernels.slope import median_slope
from curvelake.operators.grid import KEY, half_even

def by_time():
    return Window.partitionBy(KEY).orderBy("time_h")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def steps(obs: DataFrame) -> DataFrame:
    """Points with the step to each from the one before."""
    p = obs.where("time_h is not null and od is not null").select(KEY, "time_h", "od")
    return p.select("*", (F.col("od") - F.lag("od").over(by_time())).alias("dy"), (F.col("time_h") - F.lag("time_h").over(by_time())).alias("dt"))


def mad_sigma(values: DataFrame, column: str = "x") -> DataFrame:
    """Per curve 1.4826 times the median distance from the median; 0 for fewer than 3 values."""
    centre = values.where(F.col(column).isNotNull()).select(KEY, column, F.percentile(column, 0.5).over(Window.partitionBy(KEY)).alias("m"))
    return centre.groupBy(KEY).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, 1.4826 * F.percentile(F.abs(F.col(column) - F.col("m")), 0.5)).otherwise(0.0).alias("sigma"))


def _sided(obs: DataFrame, cfg: LateConfig) -> DataFrame:
    """Points with late, the step and time step from the point before on the same side of the split, and the curve's noise_level.

    All windows share the curve's key, so one shuffle serves them.
    """
    side, whole = Window.partitionBy(KEY, "late"), Window.partitionBy(KEY)
    p = obs.where("time_h is not null and od is not null").select(KEY, "time_h", "od", (F.col("time_h") > cfg.start).alias("late"))
    p = p.repartition(KEY)
    p = p.select("*", (F.col("od") - F.lag("od").over(side.orderBy("time_h"))).alias("dy"), (F.col("time_h") - F.lag("time_h").over(side.orderBy("time_h"))).alias("dt"))
    p = p.select("*", F.abs(F.col("dy") - F.percentile("dy", 0.5).over(side)).alias("off"))
    spread = lambda cond: 1.4826 * F.percentile(F.when(cond, F.col("off")), 0.5).over(whole)
    enough = lambda cond: F.count(F.when(cond, 1)).over(whole) >= 6
    chosen = F.when(enough(~F.col("late")), spread(~F.col("late"))).when(enough(F.col("late")), spread(F.col("late")))
    return p.withColumn("noise_level", F.greatest(F.coalesce(chosen, F.lit(cfg.noise_floor)), F.lit(cfg.noise_floor))).drop("off")


def noise_level(obs: DataFrame, cfg: LateConfig = LateConfig()) -> DataFrame:
    """From steps between early points if there are 6 early ones, else between late points if 6; a floor below."""
    return _sided(obs, cfg).groupBy(KEY).agg(F.first("noise_level").alias("noise_level"))


@F.pandas_udf(DoubleType())
def _median_slope(times: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or len(t) < 2 else median_slope(t, v) for t, v in zip(times, values, strict=True)], dtype="float64")


def theil_sen(obs: DataFrame) -> DataFrame:
    """Per curve the median slope over all pairs of its points: no join and no list of pairs."""
    points = obs.where("time_h is not null and od is not null").groupBy(KEY).agg(F.collect_list(F.struct("time_h", "od")).alias("p"))
    return points.select(KEY, F.size("p").alias("n"), _median_slope("p.time_h", "p.od").alias("slope"))


def _last_big(p: DataFrame, *keys: str) -> DataFrame:
    """Signs of steps beyond twice the noise, and the sign of the one before."""
    p = p.withColumn("big", F.when(F.abs("dy") > 2 * F.col("noise_level"), F.signum("dy")))
    return p.withColumn("last_big", F.last("big", True).over(Window.partitionBy(*keys).orderBy("time_h").rowsBetween(Window.unboundedPreceding, -1)))


def _artifact_sums(cond: Column) -> list[Column]:
    own = lambda c: F.when(cond, c)
    y, t = own(F.col("od")), own(F.col("time_h"))
    return [
        F.count(own(F.lit(1))).alias("n"), F.avg(y).alias("mu"), F.stddev_pop(y).alias("sd"), F.count(own(F.col("big"))).alias("k"),
        F.count(own(F.when(F.col("big") != F.col("last_big"), 1))).alias("flips"), F.regr_slope(y, t).alias("fall_slope"), F.regr_r2(y, t).alias("r2"),
    ]


def _artifact_scores(cfg: LateConfig) -> tuple[Column, Column, Column, Column]:
    """cv_score, flip_score, decline_score and artifact_score from the sums."""
    cv = clip((F.col("sd") / F.greatest(F.abs("mu"), F.lit(1e-9)) - cfg.cv_low) / (cfg.cv_high - cfg.cv_low), 0.0, 1.0)
    flips = F.when(F.col("k") >= 2, clip(F.col("flips") / (F.col("k") - 1), 0.0, 1.0)).otherwise(0.0)
    fall = F.when((F.col("n") >= 4) & (F.col("fall_slope") < cfg.evaporation_slope), clip(F.coalesce("r2", F.lit(0.0)), 0.0, 1.0)).otherwise(0.0)
    return cv, flips, fall, F.when(F.col("n") < 3, 0.5).otherwise((cv + flips + fall) / 3)


def artifact_parts(late: DataFrame, noise: DataFrame, cfg: LateConfig = LateConfig()) -> DataFrame:
    """Per curve: the three indicators, their mean artifact_score, and decline_score."""
    per = _last_big(steps(late).join(noise, KEY), KEY).groupBy(KEY).agg(*_artifact_sums(F.lit(True)))
    cv, flips, fall, score = _artifact_scores(cfg)
    return per.select(KEY, "n", cv.alias("cv_score"), flips.alias("flip_score"), fall.alias("decline_score"), score.alias("artifact_score"))


def _needed(n: Column, span: Column, cfg: LateConfig) -> Column:
    rate = F.when((n >= 2) & (span > 0), (n - 1) / span).otherwise(2.0)
    return clip(half_even(rate * 2.5), cfg.min_points, 10).cast("int")


def required_points(early: DataFrame, cfg: LateConfig = LateConfig()) -> DataFrame:
    """Per curve the late points needed: 2.5 hours at the early rate (2 an hour if unknown), 3 to 10, halves to even."""
    per = early.where("time_h is not null and od is not null").groupBy(KEY).agg(F.count("*").alias("n"), (F.max("time_h") - F.min("time_h")).alias("span"))
    return per.select(KEY, _needed(F.col("n"), F.col("span"), cfg).alias("min_late_points_required"))


def data_quality(n: Column, span: Column, needed: Column, full_span: float = 4.0) -> Column:
    return F.when(n < needed, 0.0).otherwise((F.least(F.lit(1.0), n / (2 * needed)) + F.least(F.lit(1.0), span / full_span) + 1.0) / 3)


def late_evidence(obs: DataFrame, cfg: LateConfig = LateConfig()) -> DataFrame:
    """One row per curve; curves without enough late data get the neutral row (z 0, artifact 0.5, quality 0)."""
    late, early = F.col("late"), ~F.col("late")
    t, y = F.when(late, F.col("time_h")), F.when(late, F.col("od"))
    point = F.when(late, F.struct("time_h", "od"))
    per = _last_big(_sided(obs, cfg), KEY, "late").groupBy(KEY).agg(
        *_artifact_sums(late), F.count("*").alias("n_all"), F.first("noise_level").alias("noise_level"), F.collect_list(point).alias("points"),
        F.count(F.when(early, 1)).alias("n_early"), (F.max(F.when(early, F.col("time_h"))) - F.min(F.when(early, F.col("time_h")))).alias("early_span"),
        F.nullif(F.count(t), F.lit(0)).alias("n_late"), (F.max(t) - F.min(t)).alias("late_span"), F.percentile(F.when(late & (F.col("dt") > 0), F.col("dt")), 0.5).alias("dt_med"), (F.max_by(y, t) - F.min_by(y, t)).alias("late_delta"),
    )
    _, _, fall, score = _artifact_scores(cfg)
    needed = F.when(F.col("n_early") > 0, _needed(F.col("n_early"), F.col("early_span"), cfg))
    e = per.select(KEY, "n_all", "noise_level", "n_late", "late_span", "dt_med", "late_delta", needed.alias("min_late_points_required"), _median_slope("points.time_h", "points.od").alias("late_slope"), score.alias("artifact_score"), fall.alias("decline_score"))
    n, m = F.coalesce("n_late", F.lit(0)), F.coalesce("min_late_points_required", F.lit(5))
    expected = half_even(F.col("late_span")) + 1
    missing = F.when(F.col("late_span") > 0, F.greatest(F.lit(0.0), expected - n) / expected)
    ok = (F.col("n_all") >= cfg.min_points) & (n >= m) & (F.coalesce(missing, F.lit(0.0)) <= cfg.max_missing)
    z = F.when(n >= 2, F.least(F.lit(cfg.z_cap), F.abs("late_slope") / F.greatest(F.col("noise_level") / F.coalesce("dt_med", F.lit(1.0)), F.lit(1e-12)))).otherwise(0.0)
    e = e.select(
        KEY, n.cast("long").alias("late_n_points"), m.cast("int").alias("min_late_points_required"), F.col("late_span").alias("late_span_hours"), ok.alias("late_coverage_ok"),
        F.when(ok, F.col("noise_level")).alias("noise_level"), F.when(ok, F.col("late_slope")).alias("late_slope"), F.when(ok, F.col("late_delta")).alias("late_delta"),
        F.when(ok, z).otherwise(0.0).alias("growth_z_like"), F.when(ok, F.col("artifact_score")).otherwise(0.5).alias("artifact_score"), F.when(ok, F.col("decline_score")).otherwise(0.0).alias("decline_score"),
        F.when(ok, data_quality(n, F.col("late_span"), m, cfg.full_span)).otherwise(0.0).alias("data_quality"),
    )
    return e.withColumn("decision_confidence", clip(F.col("data_quality") * clip(F.col("growth_z_like") / cfg.z_full, 0.0, 1.0) * (1 - F.col("artifact_score")), 0.0, 1.0))


def checker_status(label: Column, cfg: LateConfig = LateConfig()) -> tuple[Column, Column]:
    """(status, reason code) from a stage-1 label and the evidence columns."""
    growth, artifact, decline = F.col("growth_z_like") >= cfg.z_strong, F.col("artifact_score") >= cfg.artifact, F.col("decline_score") >= cfg.decline
    cases = [
        (F.col("data_quality") < cfg.quality, "Insufficient", "S2_INSUFFICIENT_DATA_QUALITY"),
        ((label == "Invalid") & growth & ~artifact, "Contradiction", "S2_CONTRADICTORY_LATE_GROWTH"),
        (label == "Invalid", "Corroborated", "S2_CORROBORATES_INVALID"),
        ((label == "Valid") & artifact, "Contradiction", "S2_ARTIFACT_DETECTED"),
        ((label == "Valid") & decline, "Contradiction", "S2_LATE_DECLINE_DETECTED"),
        ((label == "Valid") & growth, "Corroborated", "S2_CONTINUED_GROWTH"),
        (label == "Valid", "Corroborated", "S2_STABLE_OR_PLATEAU"),
    ]
    status, reason = F.lit("Corroborated"), F.lit("S2_STAGE1_MISSING_OR_UNKNOWN")
    for cond, s, r in reversed(cases):
        status, reason = F.when(cond, s).otherwise(status), F.when(cond, r).otherwise(reason)
    return status, reason
