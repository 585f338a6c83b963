"""Curve fits over Spark: curves packed into rows of arrays, fitted in vectorised batches, results with fixed schemas.

The input has curve_key, time_h, od.  One shuffle on curve_key packs each curve, tens to thousands of points, into
one row; tasks then fit many rows at once.  The bytes of curves say nothing of the seconds they take, so the number
of partitions follows the number of curves and what a fit costs (``dealt``) and isn't left to adaptive execution, which
would put all of them into one task.  Random draws are seeded by the curve's key, so partitioning changes nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.config import FitConfig
from curvelake.kernels import dose, growth
from curvelake.operators.grid import KEY
from curvelake.operators.metrics import bootstrap_summary

SPLINE = f"{KEY} string, success boolean, message string, n int, mu double, lag double, a double, integral double, lam double, df double, rss double, smoothing string"
MODEL = f"{KEY} string, success boolean, message string, n int, model string, mu double, lag double, a double, integral double, mu_se double, lag_se double, a_se double, rss double, aic double, bic double, second_aic double, params array<double>, aic_table array<struct<model:string,status:string,aic:double>>"
DRAWS = f"{KEY} string, replicate int, mu double, lag double, a double, integral double"


def _number(x):
    return None if x is None or not np.isfinite(x) else float(x)


def _clean(obs: DataFrame) -> DataFrame:
    return obs.where("time_h is not null and od is not null").select(KEY, "time_h", "od")


TASK_SECONDS = 60.0


def dealt(df: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """df shuffled by keys into tasks of about a minute, where one key takes so many seconds; at least two tasks a core if there are as many keys."""
    n = df.agg(F.approx_count_distinct(F.struct(*keys), 0.02)).first()[0]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(n, 2 * cores), int(n * seconds / TASK_SECONDS)), *keys)


def packed(obs: DataFrame, seconds: float) -> DataFrame:
    """A row per curve: its key, times in order and values."""
    points = F.array_sort(F.collect_list(F.struct("time_h", "od")))
    rows = dealt(_clean(obs), [KEY], seconds).groupBy(KEY).agg(points.alias("points"))
    return rows.select(KEY, F.col("points.time_h").alias("time_h"), F.col("points.od").alias("od"))


_ARROW = {
    "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()),
    "array<struct<model:string,status:string,aic:double>>": pa.list_(pa.struct([("model", pa.string()), ("status", pa.string()), ("aic", pa.float64())])),
}
_AT_ONCE = 128


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows under a schema of names and types."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for (_, t), c in zip(fields, columns, strict=True)], names=[n for n, _ in fields])


def _each(obs: DataFrame, schema: str, rows_of, seconds: float) -> DataFrame:
    """rows_of(keys, curves) of some curves at a time, under the schema."""

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), _AT_ONCE):
                keys, t, y = (batch.column(c)[k : k + _AT_ONCE] for c in range(3))
                curves = [(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(t, y, strict=True)]
                yield _table(schema, rows_of(keys.to_pylist(), curves))

    return packed(obs, seconds).mapInArrow(run, schema)


def _spline_row(key: str, r: dict) -> tuple:
    return (key, r["success"], r["message"], r.get("n", 0), *(_number(r.get(c)) for c in ("mu", "lag", "a", "integral", "lam", "df", "rss")), r.get("smoothing"))


def spline_fit(obs: DataFrame, lam: float | None = None) -> DataFrame:
    return _each(obs, SPLINE, lambda keys, curves: [_spline_row(k, r) for k, r in zip(keys, growth.fit_splines(curves, lam), strict=True)], 0.01)


class ColumnMath:
    """What the growth formulas compute with, over columns: stays in generated code."""

    exp, log = staticmethod(F.exp), staticmethod(F.log)

    @staticmethod
    def clip(x, lo, hi):
        return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))

    @staticmethod
    def maximum(x, least):
        return F.greatest(x, F.lit(float(least)))


def model_curve(model: str, t: Column, *params: float) -> Column:
    """A growth model's value at a time column."""
    return growth.MODELS[model](t, *params, m=ColumnMath)


def information_criteria(rss: Column, n: Column, k: int) -> tuple[Column, Column]:
    """AIC and BIC of a least-squares fit of k parameters."""
    return growth.aic(rss, n, k, m=ColumnMath), growth.bic(rss, n, k, m=ColumnMath)


def _model_row(key: str, r: dict) -> tuple:
    numbers = (_number(r.get(c)) for c in ("mu", "lag", "a", "integral", "mu_se", "lag_se", "a_se", "rss", "aic", "bic", "second_aic"))
    return (key, r["success"], r["message"], r.get("n", 0), r.get("model"), *numbers, list(map(float, r["params"])) if r["success"] else None, [{"model": m, "status": s, "aic": _number(a)} for m, s, a in r["aic_table"]])


def model_fit(obs: DataFrame) -> DataFrame:
    return _each(obs, MODEL, lambda keys, curves: [_model_row(k, r) for k, r in zip(keys, growth.fit_models_many(curves), strict=True)], 0.02)


def _draws_of(key: str, curve: tuple, base: dict, cfg: FitConfig, method: str) -> dict:
    return growth.bootstrap_spline(*curve, key, cfg.bootstrap_curve, method, cfg.seed, base=base)


def spline_draws(obs: DataFrame, replicates: int = 200, method: str = "pairs", seed: int = 42) -> DataFrame:
    """One row per curve and replicate."""

    def rows(keys, curves):
        out = []
        for key, curve, base in zip(keys, curves, growth.fit_splines(curves), strict=True):
            r = growth.bootstrap_spline(*curve, key, replicates, method, seed, base=base)
            out += [(key, i, *(_number(r[c][i]) for c in growth.PARAMETERS)) for i in range(len(r["mu"]))] if r else []
        return out

    return _each(obs, DRAWS, rows, 0.05)


BOOT = f"{KEY} string, parameter string, n long, mean double, sd double, ci_lo double, ci_hi double, q05 double, q95 double"


def spline_bootstrap(obs: DataFrame, cfg: FitConfig = FitConfig(), method: str = "pairs") -> DataFrame:
    """curve_key, parameter, n, mean, sd, ci_lo, ci_hi, q05, q95: draws are summed up where they are made."""

    def rows(keys, curves):
        bases = growth.fit_splines(curves)
        return [(key, p, *row) for key, curve, base in zip(keys, curves, bases, strict=True) for p, row in growth.bootstrap_summary(_draws_of(key, curve, base, cfg, method), cfg.alpha).items()]

    return _each(obs, BOOT, rows, 0.05)


WITH_INTERVALS = SPLINE + ", " + ", ".join(f"{p}_{side} double" for p in growth.PARAMETERS for side in ("lo", "hi")) + ", n_boot int"


def spline_with_intervals(obs: DataFrame, cfg: FitConfig = FitConfig(), method: str = "pairs") -> DataFrame:
    """The spline fit and its bootstrap intervals in one pass over each curve; the base fit is made once."""

    def rows(keys, curves):
        out = []
        for key, curve, base in zip(keys, curves, growth.fit_splines(curves), strict=True):
            found = growth.bootstrap_summary(_draws_of(key, curve, base, cfg, method), cfg.alpha) if base["success"] else {}
            sides = [v for p in growth.PARAMETERS for v in (found[p][3:5] if p in found else (None, None))]
            out.append((*_spline_row(key, base), *sides, min((x[0] for x in found.values()), default=0)))
        return out

    return _each(obs, WITH_INTERVALS, rows, 0.05)


def with_intervals(fits: DataFrame, boot: DataFrame) -> DataFrame:
    """Fits with ci_lo and ci_hi of each parameter, by key."""
    parts = [c for p in ("mu", "lag", "a", "integral") for c in (F.max(F.when(F.col("parameter") == p, F.col("ci_lo"))).alias(f"{p}_lo"), F.max(F.when(F.col("parameter") == p, F.col("ci_hi"))).alias(f"{p}_hi"))]
    return fits.join(boot.groupBy(KEY).agg(*parts), KEY, "left")


def curve_band(obs: DataFrame, replicates: int = 200, points: int = FitConfig.grid, seed: int = 42) -> DataFrame:
    """Payload for plots: per curve arrays of the grid, the spline, its derivative, the model and a 95 % band."""
    schema = f"{KEY} string, grid array<double>, spline array<double>, slope array<double>, model array<double>, lo array<double>, hi array<double>"

    def rows(keys, curves):
        out = []
        for key, curve, s, m in zip(keys, curves, growth.fit_splines(curves, points=points), growth.fit_models_many(curves, points), strict=True):
            draws = growth.bootstrap_spline(*curve, key, replicates, "residual", seed, points, base=s) if s["success"] else {}
            band = np.percentile(draws["curves"], [2.5, 97.5], axis=0) if draws else (None, None)
            out.append((key, *(None if not s["success"] or v is None else v.tolist() for v in (s.get("grid"), s.get("curve"), s.get("slope"), m.get("curve"), *band))))
        return out

    return _each(obs, schema, rows, 0.08)


# dose response

DOSE = "test_id string, success boolean, message string, method string, n_points int, ec50 double, y_ec50 double, rss double, aic double, lam double, monotonic boolean"


def response_table(curves: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """test_id, concentration, response: per test the first column with any finite value."""
    keys = keys or ["test_id"]
    counts = curves.groupBy(*keys).agg(*(F.count(F.when(~F.isnan(c), F.col(c))).alias(f"_n_{c}") for c in columns))
    joined = curves.join(counts, keys)
    value, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for c in reversed(columns):
        value, name = F.when(F.col(f"_n_{c}") > 0, F.col(c)).otherwise(value), F.when(F.col(f"_n_{c}") > 0, F.lit(c)).otherwise(name)
    return joined.select(*keys, "concentration", value.alias("response"), name.alias("response_column"))


def dose_gate(responses: DataFrame, least: int = 6) -> DataFrame:
    """Per test: distinct doses, their span in orders of magnitude, whether a log scale is advisable, a reason not to fit."""
    per = responses.where("response is not null").groupBy("test_id").agg(F.countDistinct("concentration").alias("n_conc"), F.max("concentration").alias("hi"), F.min(F.when(F.col("concentration") > 0, F.col("concentration"))).alias("lo"))
    span = F.when(F.col("lo").isNotNull(), F.log10(F.col("hi") / F.col("lo")))
    return per.select("test_id", "n_conc", span.alias("span"), F.coalesce(span >= 2, F.lit(False)).alias("log_advisable"), F.when(F.col("n_conc") < least, F.concat(F.lit("too_few_conc_points_"), F.col("n_conc").cast("string"))).alias("reason"))


def dose_fit(responses: DataFrame, cfg: FitConfig = FitConfig(), x_log: str = "log", y_log: str = "none", method: str = "auto") -> DataFrame:
    least = cfg.min_doses

    def run(key, pdf):
        x, y = pdf["concentration"].to_numpy(float), pdf["response"].to_numpy(float)
        n = len(np.unique(x[np.isfinite(x)]))
        r = dose.fit_dose(x, y, x_log, y_log, method) if n >= least else {"success": False, "message": f"too_few_conc_points_{n}"}
        row = [key[0], r["success"], r["message"], r.get("method"), n, *(_number(r.get(c)) for c in ("ec50", "y_ec50", "rss", "aic", "lam")), r.get("monotonic")]
        return pd.DataFrame([row], columns=[c.split()[0] for c in DOSE.split(", ")])

    points = responses.where("response is not null and concentration is not null").select("test_id", "concentration", "response")
    return dealt(points, ["test_id"], 0.05).groupBy("test_id").applyInPandas(run, DOSE)


def dose_bootstrap(responses: DataFrame, cfg: FitConfig = FitConfig(), chunk: int = 25, **options) -> DataFrame:
    """test_id, n, mean, sd, ci_lo, ci_hi, q05, q95, crossing_rate of the EC50, a row per test; chunks of replicates are groups of their own.

    Without any replicate that crosses (or with fewer than six points) n and the rate are 0, the rest is NULL.
    """
    total = cfg.bootstrap_dose

    def run(key, table):
        first = key[1].as_py() * chunk
        x, y = (table[c].to_numpy().astype(float) for c in ("concentration", "response"))
        ec50 = dose.bootstrap_dose(x, y, key[0].as_py(), range(first, min(first + chunk, total)), cfg.seed, **options)
        return pa.table({"test_id": pa.array([key[0].as_py()] * len(ec50), pa.string()), "ec50": pa.array(ec50, pa.float64())})

    points = responses.where("response is not null and concentration is not null").select("test_id", "concentration", "response")
    chunks = points.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((total - 1) // chunk))))
    draws = dealt(chunks, ["test_id", "chunk"], 0.01 * chunk).groupBy("test_id", "chunk").applyInArrow(run, "test_id string, ec50 double")
    found = bootstrap_summary(draws, ["test_id"], "ec50", cfg.alpha)
    every = points.groupBy("test_id").agg(F.count("*").alias("_n")).drop("_n").join(found, "test_id", "left")
    return every.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("crossing_rate", F.col("n") / float(total))


def ec50_interpolated(responses: DataFrame) -> DataFrame:
    """EC50 by straight lines between mean responses: the first crossing of the middle of both ends, in Catalyst."""
    from pyspark.sql.window import Window

    mean = responses.where("response is not null and concentration is not null").groupBy("test_id", "concentration").agg(F.avg("response").alias("y"))
    w, whole = Window.partitionBy("test_id").orderBy("concentration"), Window.partitionBy("test_id").orderBy("concentration").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = mean.select("*", F.lead("concentration").over(w).alias("c1"), F.lead("y").over(w).alias("y1"), ((F.first("y").over(whole) + F.last("y").over(whole)) / 2).alias("middle"))
    hit = p.where("c1 is not null and (y - middle) * (y1 - middle) <= 0 and y <> y1").select("test_id", "middle", (F.col("concentration") + (F.col("middle") - F.col("y")) / (F.col("y1") - F.col("y")) * (F.col("c1") - F.col("concentration"))).alias("ec50"))
    return hit.groupBy("test_id").agg(F.min("ec50").alias("ec50"), F.first("middle").alias("middle"), F.count("*").alias("n_crossings"))


def dose_band(responses: DataFrame, samples: int = 300, points: int = FitConfig.grid, x_log: str = "log", seed: int = 42) -> DataFrame:
    """Payload for plots: per test the doses, responses, the fit on a grid of doses and a pair-bootstrap band (40 to 250 draws)."""
    schema = "test_id string, x array<double>, y array<double>, grid array<double>, curve array<double>, lo array<double>, hi array<double>, ec50 double"
    draws = int(np.clip(samples, 40, 250))

    def on_grid(r: dict, grid: np.ndarray) -> np.ndarray | None:
        if not r["success"]:
            return None
        if r["method"] != "spline":
            return dose.hill(grid, *r["params"])
        return np.interp(dose.transform_x(grid, x_log), r["grid"], r["curve"])

    def run(key, pdf):
        x, y = pdf["concentration"].to_numpy(float), pdf["response"].to_numpy(float)
        base = dose.fit_dose(x, y, x_log)
        positive = x[x > 0]
        as_list = lambda v: None if v is None else [float(a) for a in v]
        if not base["success"] or not len(positive):
            return pd.DataFrame([[key[0], as_list(x), as_list(y), None, None, None, None, None]], columns=[c.split()[0] for c in schema.split(", ")])
        grid = np.geomspace(positive.min(), x.max(), points)
        options = {"method": "spline" if base["method"] == "spline" else "4pl", "lam": base.get("lam")}
        picks = (np.random.default_rng([growth.stable_seed(key[0], seed), k]).integers(0, len(x), len(x)) for k in range(draws))  # one at a time: a test may have any number of points
        fits = dose.fit_hills((x[p], y[p]) for p in picks) if options["method"] == "4pl" else (dose.fit_dose(x[p], y[p], x_log, **options) for p in picks)
        rows = [r for r in (on_grid(f, grid) for f in fits) if r is not None]
        lo, hi = np.percentile(rows, [2.5, 97.5], axis=0) if len(rows) >= 10 else (None, None)
        return pd.DataFrame([[key[0], as_list(x), as_list(y), as_list(grid), as_list(on_grid(base, grid)), as_list(lo), as_list(hi), base["ec50"]]], columns=[c.split()[0] for c in schema.split(", ")])

    given = responses.where("response is not null and concentration is not null").select("test_id", "concentration", "response")
    return dealt(given, ["test_id"], 1.0).groupBy("test_id").applyInPandas(run, schema)


def curve_audit(spline: DataFrame, models: DataFrame) -> DataFrame:
    """One row per curve: how each fit went, the model chosen, its lead over the next AIC, how the spline was smoothed."""
    s = spline.select(KEY, F.col("success").alias("spline_ok"), F.col("message").alias("spline_message"), "smoothing", "df", "lam", F.col("n").alias("n_obs"))
    m = models.select(KEY, F.col("success").alias("model_ok"), F.col("message").alias("model_message"), "model", "aic", "bic", (F.col("second_aic") - F.col("aic")).alias("aic_lead"), F.transform("aic_table", lambda r: F.concat(r["model"], F.lit(":"), r["status"])).alias("tried"))
    return s.join(m, KEY, "left")


def dose_audit(fits: DataFrame, gate: DataFrame, boot: DataFrame | None = None) -> DataFrame:
    """One row per test: doses, span, the reason where nothing was fitted, the method, monotonicity, the crossing rate."""
    out = gate.join(fits.select("test_id", "success", "message", "method", "monotonic", "aic"), "test_id", "left")
    if boot is not None:
        out = out.join(boot.select("test_id", "crossing_rate"), "test_id", "left")
    return out.withColumn("reason", F.coalesce("reason", F.nullif("message", F.lit("")))).drop("message")
