"""Registered queries over the test tables: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelake.config import SELECTED_FEATURES, GridConfig
from curvelake.functions import scalars as S
from curvelake.operators import augment, evidence, features, fit, grid, labels, metrics, reshape, signal
from curvelake.sources.events import observations

KEY = grid.KEY


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def _obs(spark, d):
    return observations(spark, d)


def _raw(spark, d):
    """The un-cumulated values, the mean of repeated times."""
    return _obs(spark, d).groupBy(KEY, "time_h").agg(F.avg("od_raw").alias("od"))


def _rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles multiplied, rounded to whole numbers and divided, as SQL engines do: F.round takes their shortest decimals, so it parts from them a bit below a half."""
    kinds = dict(df.dtypes)
    unit = lambda c: F.lit(10.0 ** other.get(c, digits))
    return df.select(*((F.round(F.col(c) * unit(c)) / unit(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


def _seen(spark, d):
    return signal.observed(grid.grid_interpolate(_obs(spark, d))).select(KEY, "time_h", "od")


def curve_point_stats(spark, d):
    return _rounded(grid.point_stats(_obs(spark, d)))


def dedupe_mean_long(spark, d):
    day = F.date_trunc("day", F.col("ts").cast("timestamp_ntz"))
    e = _read(spark, d, "events").select("user_id", day.alias("day"), F.col("value").alias("od"), F.unix_micros(day.cast("timestamp")).alias("time_h"))
    mean = grid.dedupe_mean(e, ["user_id", "day"], "n")
    return mean.select("user_id", "day", F.round("od", 6).alias("mean_value"), "n")


def long_to_wide(spark, d):
    times = [0.0, 4.0, 8.0, 12.0, 16.0]
    wide = reshape.long_to_wide(grid.grid_interpolate(_obs(spark, d)), [KEY], times=times)
    return wide.select(KEY, *(F.round(F.col(f"`{reshape.header_of_time(t)}`"), 6).alias(f"t{int(t)}") for t in times))


def wide_to_long(spark, d):
    """Three measures of each line as if they were taken at three times."""
    names = ["l_quantity", "l_discount", "l_tax"]
    wide = _read(spark, d, "lineitem").select("l_returnflag", *(F.col(c).alias(reshape.header_of_time(float(i))) for i, c in enumerate(names)))
    measure = F.get(F.array(*map(F.lit, names)), F.col("time_h").cast("int"))
    return reshape.wide_to_long(wide).groupBy("l_returnflag", measure.alias("measure")).agg(F.count("*").alias("n"), F.round(F.avg("od"), 4).alias("mean_value"))


def _users(spark, d):
    return _read(spark, d, "events").select("user_id").distinct()


def conc_from_id(spark, d):
    u = F.col("user_id")
    text = F.when(u % 4 == 0, F.concat(F.lit("A"), u, F.lit("[Conc="), (u / 4).cast("string"), F.lit("]"))).when(u % 4 == 1, F.concat(F.lit("B[ "), u, F.lit(" ]"))).when(u % 4 == 2, F.lit("C[x]")).otherwise(F.concat(F.lit("D"), u))
    return _users(spark, d).select("user_id", text.alias("curve_id")).withColumn("conc", S.conc_from_id(F.col("curve_id")))


def duration_to_hours(spark, d):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, F.concat((e % 24).cast("string"), F.lit("h "), (e % 60).cast("string"), F.lit("m"))).when(e % 4 == 1, F.concat((e % 90).cast("string"), F.lit("m"))).when(e % 4 == 2, F.concat((e % 50).cast("string"), F.lit(",5"))).otherwise(F.lit("t0"))
    return _read(spark, d, "events").select("event_id", S.duration_hours(text).alias("hours"))


def time_unit_inference(spark, d):
    """Half-hour steps written in hours, minutes and seconds by user; the unit is inferred from their size."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    unit = F.col("user_id") % 3
    e = _read(spark, d, "events").select("user_id", unit.alias("unit"), ((F.row_number().over(w) - 1) * 0.5 * F.when(unit == 0, 1).when(unit == 1, 60).otherwise(3600)).alias("t"))
    e = e.withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t")))
    per = e.groupBy("user_id", "unit").agg(F.max("t").alias("top"), F.percentile("dt", 0.5).alias("step"))
    return per.select("user_id", "unit", F.round(F.col("top") * S.time_scale(F.lit(None).cast("string"), F.col("step"), F.col("top")), 6).alias("span_hours"))


def curve_key_attach(spark, d):
    u = F.col("user_id")
    dose = F.get(F.array(*(F.lit(x) for x in (0.0, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0))), u.cast("int") % 8)
    ident = F.when(u % 3 == 0, F.concat(F.lit("U"), u, F.lit("[Conc=1]"))).otherwise(F.concat(F.lit("U"), u))
    return _users(spark, d).select("user_id", S.curve_key(ident, F.when(u % 3 != 1, dose)).alias("curve_key"))


def grid_interpolate(spark, d):
    return _rounded(grid.grid_interpolate(_obs(spark, d)))


def grid_missing(spark, d):
    return grid.grid_missing(grid.grid_interpolate(_obs(spark, d)))


def baseline_correct(spark, d):
    return _rounded(signal.baseline_correct(_seen(spark, d)))


def rolling_smooth(spark, d):
    return _rounded(signal.rolling_smooth(_seen(spark, d)))


def savgol_smooth(spark, d):
    return _rounded(signal.savgol_smooth(_seen(spark, d)))


def lowess_smooth(spark, d):
    return _rounded(signal.lowess_smooth(_seen(spark, d)))


def max_normalize(spark, d):
    return _rounded(signal.normalize(_seen(spark, d), "MAX"))


def minmax_normalize(spark, d):
    return _rounded(signal.normalize(_seen(spark, d), "MINMAX"))


def preprocess_chain(spark, d):
    return _rounded(signal.preprocess(grid.grid_interpolate(_obs(spark, d))))


def _features(spark, d):
    early = _obs(spark, d).where("time_h <= 16")
    points = signal.preprocess(grid.grid_interpolate(early))
    return features.features(points, grid.point_stats(early))


def _rounded_features(f):
    return _rounded(f, 5, observed_tmax=6, max_gap_hours=6, missing_frac_on_grid=6)


def features_all(spark, d):
    return _rounded_features(_features(spark, d))


def truncated_features(spark, d):
    """Features of every curve cut at its horizons: the larger part of the training table."""
    cut = augment.truncate(_obs(spark, d), 3).select(F.col("aug_id").alias(KEY), "time_h", "od")
    return _rounded_features(features.features(signal.preprocess(grid.grid_interpolate(cut)), grid.point_stats(cut, GridConfig(min_points=3))))


def mad_noise(spark, d):
    return _rounded(evidence.noise_level(_raw(spark, d)))


def theil_sen(spark, d):
    return _rounded(evidence.theil_sen(_raw(spark, d).where("time_h > 16")).where("slope is not null").select(KEY, "slope"))


def artifact_score(spark, d):
    raw = _raw(spark, d)
    return _rounded(evidence.artifact_parts(raw.where("time_h > 16"), evidence.noise_level(raw)).drop("n"))


def dynamic_min_points(spark, d):
    return evidence.required_points(_raw(spark, d).where("time_h <= 16"))


def stage2_evidence(spark, d):
    return _rounded(evidence.late_evidence(_raw(spark, d)), 6, growth_z_like=5)


def _votes(spark, d):
    """Stand-ins for model outputs: hashes of the key; one model in five has none."""
    u = lambda name: augment.uniform(F.lit(name), F.col(KEY))
    p = _obs(spark, d).select(KEY).distinct().select(KEY, u("HGB").alias("p_hgb"), u("RF").alias("p_rf"), F.when(u("gap") >= 0.2, u("LR")).alias("p_lr"))
    return labels.ensemble(p, {"p_hgb": 0.4, "p_rf": 0.35, "p_lr": 0.25})


def ensemble_vote(spark, d):
    return _votes(spark, d).select(KEY, "confidence_valid", "pred_label", "pred_confidence")


def _assigned(spark, d):
    return labels.assign_labels(_votes(spark, d).join(evidence.late_evidence(_raw(spark, d)), KEY))


def stage2_status(spark, d):
    return _assigned(spark, d).select(KEY, "pred_label", "stage2_label", "label_reason", "final_label")


def _final(spark, d):
    return labels.apply_overrides(_assigned(spark, d).join(_features(spark, d), KEY), SELECTED_FEATURES)


def final_labels(spark, d):
    return _final(spark, d).select(KEY, "pred_label", "stage2_label", "label_reason", "final_label")


def validity_join(spark, d):
    joined = labels.validity_join(_obs(spark, d), _final(spark, d))
    return joined.groupBy(KEY).agg(F.count("*").alias("n"), F.count(F.when(F.col("is_valid_final"), 1)).alias("n_valid"))


def membership_filter(spark, d):
    chosen = labels.eligible(_final(spark, d), include_unsure=True).select(KEY)
    return _obs(spark, d).join(chosen, KEY, "left_semi").groupBy(KEY).agg(F.count("*").alias("n"))


def label_counts(spark, d):
    return labels.label_counts(_final(spark, d))


def audit_join(spark, d):
    obs = _obs(spark, d)
    processed = signal.preprocess(grid.grid_interpolate(obs.where("time_h <= 16")))
    curves = obs.groupBy(KEY).agg(F.first("test_id").alias("test_id"), F.first("concentration").alias("concentration"))
    final = _final(spark, d).select(KEY, "pred_label", "final_label", "label_reason")
    audit = labels.audit_table(curves, final, _features(spark, d), processed, labels.review_table(final))
    total = F.aggregate("processed", F.lit(0.0), lambda a, x: a + x["od"])
    return audit.select(KEY, "test_id", "concentration", "pred_label", "final_label", "label_reason", *(F.round(c, 5).alias(c) for c in ("observed_tmax", "auc", "largest_drop_frac", "plateau_OD")), F.size("processed").alias("n_processed"), F.round(total, 4).alias("processed_sum"), "true_label")


def review_curves(spark, d):
    """A review of the curves that aren't unsure, beside the votes."""
    final = _final(spark, d)
    review = labels.review_table(final.where("final_label <> 'Unsure'")).drop("pred_label", "final_label")
    return labels.review_curves(ensemble_vote(spark, d), review).select(KEY, "concentration", "true_label", "reviewed", "pred_label", "pred_confidence", "confidence_valid")


def label_resolution(spark, d):
    k = F.col("doc_id") % 6
    texts = ["yes", "0.0", " unsure ", "TRUE", "invalid", "?"]
    text = F.get(F.array(*(F.lit(t) for t in texts)), k.cast("int"))
    return _read(spark, d, "labels").select("doc_id", S.first_label(F.lit(None).cast("string"), F.lit("  "), text).alias("label"))


def truncate_augment(spark, d):
    t = augment.truncate(_obs(spark, d), 3)
    return t.groupBy("aug_id", "base_curve_id", "train_horizon", "is_censored").agg(F.count("*").alias("n"))


def gap_augment(spark, d):
    g = augment.gaps(_obs(spark, d).where("time_h <= 16"))
    return g.groupBy("aug_id", "base_curve_id", "gap_kind").agg(F.count("*").alias("n"))


def _metric_rows(spark, d):
    docs, lab = _read(spark, d, "documents").select("doc_id", "lang", "source"), _read(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    p = augment.uniform(F.lit("p"), F.col("doc_id"))
    return docs.join(lab.where("y is not null"), "doc_id").withColumn("p", p).withColumn("predicted", (F.col("p") >= 0.5).cast("int"))


def class_metrics_by_slice(spark, d):
    return _rounded(metrics.metrics_by_slice(_metric_rows(spark, d), ["lang", "source"]))


def run_stability(spark, d):
    """Each source a run, each language a model."""
    runs = _metric_rows(spark, d).groupBy(F.col("lang").alias("model"), "source").agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg("p").alias("mean_score"))
    return _rounded(metrics.stability(runs, ["accuracy", "mean_score"]))


def roc_auc(spark, d):
    return _rounded(metrics.roc_auc(_metric_rows(spark, d), ["lang"]))


def average_precision(spark, d):
    return _rounded(metrics.average_precision(_metric_rows(spark, d), ["lang"]))


def class_weights(spark, d):
    return _rounded(metrics.class_weights(_metric_rows(spark, d)))


def group_split(spark, d):
    return metrics.group_split(_metric_rows(spark, d), "source").groupBy("source", "split").agg(F.count("*").alias("n"))


def bootstrap_mean_ci(spark, d):
    w = Window.partitionBy(KEY).orderBy("time_h", "event_id")
    curves = fit.dealt(_obs(spark, d).select(KEY, "time_h", "event_id", "od_raw"), [KEY], 0.003)
    points = curves.select(KEY, (F.row_number().over(w) - 1).alias("ix"), F.col("od_raw").alias("v"))
    means = metrics.resampled_means(points, KEY, "ix", "v", 50)
    # means of prices in cents end in exact halves at the sixth digit: the last bit may not decide how they round
    found = metrics.bootstrap_summary(means, [KEY], "m")
    return _rounded(found.select(KEY, "n", *((F.col(c) + 1e-9).alias(c) for c in ("mean", "sd", "ci_lo", "ci_hi"))))


def model_curve_eval(spark, d):
    t = F.col("time_h")
    return _rounded(_obs(spark, d).select(KEY, t.alias("t"), *(fit.model_curve(m, t, 0.1, 2.0, 0.5, 3.0).alias(m) for m in ("logistic", "gompertz"))))


def aic_table(spark, d):
    """The criteria of a straight line through each curve."""
    obs = _obs(spark, d)
    line = obs.groupBy(KEY).agg(F.regr_slope("od", "time_h").alias("s"), F.regr_intercept("od", "time_h").alias("i"))
    rss = obs.join(line, KEY).groupBy(KEY).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("od") - (F.col("s") * F.col("time_h") + F.col("i")), 2)).alias("rss"))
    aic, bic = fit.information_criteria(F.col("rss"), F.col("n"), 2)
    return _rounded(rss.select(KEY, "n", aic.alias("aic"), bic.alias("bic")))


def _responses(spark, d):
    per = _obs(spark, d).groupBy(KEY, "test_id", "concentration").agg(F.max("od").alias("a_spline"), F.avg("od_raw").alias("a_model"))
    return fit.response_table(per, ["a_spline", "a_model"])


def dr_response_table(spark, d):
    return _rounded(_responses(spark, d).groupBy("test_id", "concentration").agg(F.count("*").alias("n"), F.avg("response").alias("response")))


def conc_span(spark, d):
    return _rounded(fit.dose_gate(_responses(spark, d)))


def ec50_linear_crossing(spark, d):
    return _rounded(fit.ec50_interpolated(_responses(spark, d)))


def gc_spline_fit(spark, d):
    return fit.spline_fit(_obs(spark, d))


def gc_model_fit(spark, d):
    return fit.model_fit(_obs(spark, d))


def gc_boot(spark, d):
    return fit.spline_with_intervals(_obs(spark, d))


def dr_fit(spark, d):
    return fit.dose_fit(_responses(spark, d))


def dr_boot(spark, d):
    return fit.dose_bootstrap(_responses(spark, d))


def dr_payload(spark, d):
    return fit.dose_band(_responses(spark, d))


def gc_audit(spark, d):
    obs = _obs(spark, d)
    return fit.curve_audit(fit.spline_fit(obs), fit.model_fit(obs))


def dr_audit(spark, d):
    responses = _responses(spark, d)
    return fit.dose_audit(fit.dose_fit(responses), fit.dose_gate(responses))


def synthetic_curves(spark, d):
    """Generated, so it reads no table: the labelled set of 900 curves, counted by subtype."""
    from curvelake.sources.synthetic import synthetic_curves as make

    return make(spark).groupBy("subtype", "is_valid").agg(F.countDistinct(KEY).alias("curves"), F.count("*").alias("points"))


def train_predict(spark, d):
    """Three classifiers trained on synthetic curves label the event curves, with evidence and overrides."""
    from curvelake.ml import classifier
    from curvelake.plans import analysis
    from curvelake.sources.synthetic import synthetic_curves as make

    trained = classifier.train(analysis.training_table(make(spark).drop("subtype", "model_name")))
    return analysis.label_curves(_obs(spark, d).select(KEY, "time_h", "od"), trained).select(KEY, "p_lr", "p_rf", "p_hgb", "confidence_valid", "pred_label", "stage2_label", "label_reason", "final_label")


def curve_payload(spark, d):
    return fit.curve_band(_obs(spark, d))


def training_features(spark, d):
    """Augmented curves through grid, preprocessing and features: the training table."""
    curves = augment.training_curves(_obs(spark, d))
    return features.features(signal.preprocess(grid.grid_interpolate(curves)), grid.point_stats(curves, GridConfig(min_points=3)))


NAMES = [
    features_all, truncated_features, curve_point_stats, dedupe_mean_long, long_to_wide, wide_to_long, conc_from_id, duration_to_hours, time_unit_inference, curve_key_attach, grid_interpolate, grid_missing, baseline_correct, rolling_smooth, savgol_smooth, lowess_smooth,
    max_normalize, minmax_normalize, preprocess_chain, mad_noise, theil_sen, artifact_score, dynamic_min_points, stage2_evidence, ensemble_vote, stage2_status, final_labels, validity_join, membership_filter, label_counts, audit_join,
    review_curves, run_stability, label_resolution, truncate_augment, gap_augment, class_metrics_by_slice, roc_auc, average_precision, class_weights, group_split, bootstrap_mean_ci, model_curve_eval, aic_table, dr_response_table, conc_span, ec50_linear_crossing,
    gc_spline_fit, gc_model_fit, gc_boot, gc_audit, dr_fit, dr_boot, dr_audit, dr_payload, curve_payload, training_features, synthetic_curves, train_predict,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
