"""End-to-end plans: curves to labels, curves to fits, curves to a training table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.config import RunConfig
from curvelake.functions.scalars import bootstrap_method
from curvelake.ml import classifier
from curvelake.operators import augment, evidence, features, fit, grid, labels, reshape, signal

KEY = grid.KEY


def curve_features(obs: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    early = obs.where(F.col("time_h") <= cfg.grid.tmax)
    return features.features(signal.preprocess(grid.grid_interpolate(early, cfg.grid)), grid.point_stats(early, cfg.grid), cfg=cfg.grid)


def label_curves(obs: DataFrame, trained: dict, cfg: RunConfig = RunConfig()) -> DataFrame:
    """Features, votes, late evidence, labels with reasons, overrides; one row per curve."""
    twice = labels.duplicates(obs.select(KEY, "curve_id").distinct()) if "curve_id" in obs.columns else []
    if twice:
        raise ValueError(f"an id names more than one curve: {', '.join(twice)}")
    voted = classifier.predict(curve_features(obs, cfg), trained)
    assigned = labels.assign_labels(voted.join(evidence.late_evidence(obs, cfg.late), KEY, "left").fillna({"data_quality": 0.0, "growth_z_like": 0.0, "artifact_score": 0.5, "decline_score": 0.0}), cfg.late, cfg.overrides)
    return labels.apply_overrides(assigned, trained["features"], cfg.overrides)


def fit_curves(
    obs: DataFrame, labelled: DataFrame | None = None, cfg: RunConfig = RunConfig(), include_unsure: bool = False, include_invalid: bool = False, bootstrap: bool = True, exclude: Callable[[DataFrame], Column] | None = None,
    fits: str = "both", method: str = "pairs", response: str = "mu", dose_method: str = "auto", label: str = "final_label", curve_bootstrap: bool | None = None,
) -> dict[str, DataFrame]:
    """gc_fit, gc_model, gc_boot, gc_audit, dr_gate, dr_fit, dr_boot, dr_audit over the curves whose label lets them in.

    obs also has test_id and concentration.  ``fits`` is model, spline or both (m, s and b will do); ``response``
    the parameter that dose fits read (mu, lag, a or integral), the spline's if it was fitted and has a value;
    ``exclude`` maps the fitted rows to a mask of those left out of dose fits.
    """
    fits = {"m": "model", "s": "spline", "b": "both"}.get(fits, fits)
    if fits not in ("model", "spline", "both"):
        raise ValueError(f"fits is model, spline or both, not {fits}")
    chosen = obs if labelled is None else obs.join(labels.eligible(labelled, include_unsure, include_invalid, label).select(KEY), KEY, "left_semi")
    curves = chosen.select(KEY, "test_id", "concentration").distinct()
    out: dict[str, DataFrame] = {}
    rows, columns = curves, []
    if fits != "model":
        spline = fit.spline_fit(chosen)
        if bootstrap if curve_bootstrap is None else curve_bootstrap:
            out["gc_boot"] = fit.spline_bootstrap(chosen, cfg.fit, bootstrap_method(method))
            spline = fit.with_intervals(spline, out["gc_boot"])
        out["gc_fit"] = curves.join(spline, KEY)
        rows, columns = rows.join(spline.select(KEY, F.col(response).alias(f"{response}_spline")), KEY, "left"), [*columns, f"{response}_spline"]
    if fits != "spline":
        out["gc_model"] = fit.model_fit(chosen)
        out.setdefault("gc_fit", curves.join(out["gc_model"], KEY))
        rows, columns = rows.join(out["gc_model"].select(KEY, F.col(response).alias(f"{response}_model")), KEY, "left"), [*columns, f"{response}_model"]
    if fits == "both":
        out["gc_audit"] = fit.curve_audit(spline, out["gc_model"])
    rows = rows.where(~exclude(rows)) if exclude is not None else rows
    responses = fit.response_table(rows, columns)
    out["dr_gate"] = fit.dose_gate(responses, cfg.fit.min_doses)
    out["dr_fit"] = fit.dose_fit(responses, cfg.fit, method=dose_method)
    if bootstrap:
        out["dr_boot"] = fit.dose_bootstrap(responses, cfg.fit, method=dose_method)
        out["dr_fit"] = out["dr_fit"].join(out["dr_boot"].select("test_id", "ci_lo", "ci_hi", "crossing_rate"), "test_id", "left")
    out["dr_audit"] = fit.dose_audit(out["dr_fit"], out["dr_gate"], out.get("dr_boot"))
    return out


def export_tables(obs: DataFrame, audit: DataFrame, tables: dict[str, DataFrame], wanted: str = "Valid", include_unsure: bool = False, include_invalid: bool = False, cfg: RunConfig = RunConfig(), **options) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What a run hands out: (results, auditing), tables by name.

    audit has a row per curve with true_label (a reviewer's, else the final one).  Curve tables keep the curves
    whose label is ``wanted`` (All: every known label); dose fits are made anew over valid curves, with unsure
    and invalid ones if asked for, and without bootstrapping curves again.
    """
    known = audit.where(F.col("true_label").isin("Valid", "Invalid", "Unsure")) if wanted == "All" else labels.by_label(audit, wanted, "true_label")
    allowed = known.select(KEY).distinct()
    keep = lambda name: tables[name].join(allowed, KEY, "left_semi")
    doses = fit_curves(obs, audit, cfg, include_unsure, include_invalid, label="true_label", curve_bootstrap=False, **options)
    results = {f: keep(name) for f, name in (("gcFit", "gc_fit"), ("gcModel", "gc_model"), ("gcBoot", "gc_boot")) if name in tables}
    results |= {f: doses[name] for f, name in (("drFit", "dr_fit"), ("drBoot", "dr_boot")) if name in doses}
    auditing = {"classifier_audit": audit, "grofit_input": fit_input_table(obs, audit)}
    auditing |= {"gc_audit": keep("gc_audit")} if "gc_audit" in tables else {}
    return results, auditing | {"dr_audit": doses["dr_audit"]}


def fit_input_table(obs: DataFrame, audit: DataFrame) -> DataFrame:
    """A row per curve that could be fitted: its key, test, dose, number of points and label."""
    per = obs.groupBy(KEY).agg(F.first("test_id").alias("test_id"), F.first("concentration").alias("concentration"), F.count("od").alias("n_points"))
    return per.join(audit.select(KEY, "true_label"), KEY, "left")


def training_table(obs: DataFrame, cfg: RunConfig = RunConfig(), per_curve: int = 3, gap_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Augmented variants of labelled curves (is_valid per curve), resampled once, with features; base_curve_id groups them."""
    variants = augment.training_curves(obs, per_curve, gap_share, seed, cfg.grid)
    meta = variants.groupBy(KEY).agg(F.first("base_curve_id").alias("base_curve_id"), F.first("train_horizon").alias("horizon"), F.first("gap_augmented").alias("gap_augmented"), F.max(F.col("is_valid").cast("int")).alias("is_valid"))
    points = signal.preprocess(grid.grid_interpolate(variants, cfg.grid))
    feats = features.features(points, grid.point_stats(variants, cfg.grid), cfg=cfg.grid)
    return feats.join(meta, KEY).withColumn("train_horizon", F.col("horizon")).drop("horizon")


def training_stages(obs: DataFrame, cfg: RunConfig = RunConfig(), **augmentation) -> dict[str, DataFrame]:
    """raw_merged (the curves on the grid, a row each), final_merged (variants on the grid, preprocessed) and training_meta."""
    times = [k * cfg.grid.step for k in range(cfg.grid.points)]
    raw = grid.raw_merged(obs, cfg.grid)
    variants = augment.training_curves(obs, cfg=cfg.grid)
    final = signal.preprocess(grid.raw_merged(variants, cfg.grid))
    return {"raw_merged": reshape.long_to_wide(raw, [KEY], times=times), "final_merged": reshape.long_to_wide(final, [KEY], times=times), "training_meta": training_table(obs, cfg, **augmentation)}


def check_training_table(table: DataFrame) -> dict[str, int]:
    """Counts of what may not be: repeated keys, unknown labels, groups with both labels."""
    row = table.agg((F.count("*") - F.countDistinct(KEY)).alias("repeated"), F.count(F.when(F.col("is_valid").isNull(), 1)).alias("unlabelled")).first()
    mixed = table.groupBy("base_curve_id").agg(F.countDistinct("is_valid").alias("n")).where("n > 1").count()
    return {"repeated": row.repeated, "unlabelled": row.unlabelled, "mixed": mixed}
