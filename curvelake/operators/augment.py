"""Training-set augmentation: truncated horizons and gaps, drawn by hashes of the curve's key."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelake.config import HORIZONS, GridConfig
from curvelake.functions.scalars import conc_token, fmt_g, sanitize_token
from curvelake.operators.grid import KEY


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def letters(index: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    out = ""
    index += 1
    while index:
        index, r = divmod(index - 1, 26)
        out = string.ascii_uppercase[r] + out
    return out


def base_curve_id(file_name: Column, curve_id: Column, conc: Column) -> Column:
    return F.concat_ws("_", sanitize_token(file_name), sanitize_token(curve_id), F.concat(F.lit("c"), conc_token(conc)))


def unique_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """Second and later occurrences get _2, _3, ..."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(order))
    return df.withColumn(column, F.when(n == 1, F.col(column)).otherwise(F.concat(column, F.lit("_"), n.cast("string"))))


def horizons(curves: DataFrame, per_curve: int = 3, seed: int = 42, cfg: GridConfig = GridConfig(), choices: list[float] = HORIZONS) -> DataFrame:
    """(curve_key, train_horizon): 2 or 3 per curve, aligned down to the grid and capped at its end, by hash order."""
    k = max(2, min(3, per_curve))
    aligned = sorted({min(cfg.tmax, int(h / cfg.step + 1e-9) * cfg.step) for h in choices})
    if len(aligned) < 2:
        return curves.select(KEY, F.lit(cfg.tmax).alias("train_horizon")).limit(0)
    each = curves.select(KEY).distinct().withColumn("train_horizon", F.explode(F.array(*(F.lit(h) for h in aligned))))
    order = F.row_number().over(Window.partitionBy(KEY).orderBy(uniform(F.lit(seed), F.col(KEY), fmt_g(F.col("train_horizon"))), "train_horizon"))
    return each.withColumn("_r", order).where(F.col("_r") <= k).drop("_r")


def truncate(obs: DataFrame, per_curve: int = 3, seed: int = 42, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Each curve once per horizon, with its points up to it: adds base_curve_id, train_horizon, tmax_original, is_censored, aug_id."""
    last = obs.groupBy(KEY).agg(F.max("time_h").alias("tmax_original"))
    picked = horizons(obs, per_curve, seed, cfg).join(last, KEY)
    return obs.join(picked, KEY).where(F.col("time_h") <= F.col("train_horizon") + 1e-9).select("*", F.col(KEY).alias("base_curve_id"), (F.col("train_horizon") < F.col("tmax_original") - 1e-9).alias("is_censored"), F.concat(KEY, F.lit("_H"), fmt_g(F.col("train_horizon"))).alias("aug_id"))


def gaps(obs: DataFrame, share: float = 0.3, reps: int = 2, seed: int = 42, least: int = 4) -> DataFrame:
    """For a share of the curves, ``reps`` copies with a block gap of 2 to 6 hours or with 40 to 80 % of points dropped.

    Points are dropped in hash order, so at least ``least`` stay whatever the draw; adds base_curve_id, gap_kind, aug_id.
    """
    chosen = obs.select(KEY).distinct().where(uniform(F.lit(seed), F.lit("pick"), F.col(KEY)) < share)
    copies = chosen.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    draw = lambda name: uniform(F.lit(seed), F.lit(name), F.col(KEY), F.col("rep"))
    copies = copies.select(KEY, "rep", F.when(draw("kind") < 0.5, "B").otherwise("S").alias("gap_kind"), (2 + 4 * draw("len")).alias("gap_len"), draw("at").alias("gap_at"), (0.4 + 0.4 * draw("drop")).alias("drop_share"))
    joined = obs.join(copies, KEY)
    whole = Window.partitionBy(KEY, "rep")
    lo, hi, n = F.min("time_h").over(whole), F.max("time_h").over(whole), F.count("*").over(whole)
    start = lo + F.col("gap_at") * F.greatest(hi - lo - F.col("gap_len"), F.lit(0.0))
    marked = joined.withColumn("_in", (F.col("time_h") > start) & (F.col("time_h") < start + F.col("gap_len"))).withColumn("_u", uniform(F.lit(seed), F.lit("point"), F.col(KEY), F.col("rep"), F.col("time_h"))).withColumn("_n", n)
    hit = F.row_number().over(Window.partitionBy(KEY, "rep").orderBy(F.when(F.col("gap_kind") == "B", F.when(F.col("_in"), 0).otherwise(1)).otherwise(0), "_u", "time_h"))
    want = F.when(F.col("gap_kind") == "B", F.count(F.when(F.col("_in"), 1)).over(whole)).otherwise(F.floor(F.col("drop_share") * F.col("_n")))
    kept = marked.withColumn("_hit", hit).withColumn("_want", F.greatest(F.lit(0), F.least(want, F.col("_n") - least))).where("_hit > _want")
    return kept.withColumn("base_curve_id", F.col(KEY)).withColumn("aug_id", F.concat(KEY, F.lit("_GAP"), F.col("rep").cast("string"), F.col("gap_kind"))).drop("_in", "_u", "_n", "_hit", "_want", "gap_len", "gap_at", "drop_share", "rep")


def training_curves(obs: DataFrame, per_curve: int = 3, gap_share: float = 0.3, seed: int = 42, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Truncated and gapped variants under their own keys (curve_key = aug_id)."""
    a = truncate(obs, per_curve, seed, cfg).withColumn("gap_augmented", F.lit(0))
    b = gaps(obs.where(F.col("time_h") <= cfg.tmax), gap_share, seed=seed).withColumn("gap_augmented", F.lit(1)).withColumn("train_horizon", F.lit(cfg.tmax))
    return a.unionByName(b, allowMissingColumns=True).withColumn(KEY, F.col("aug_id"))
