"""Votes, stage-2 labels, overrides and the audit table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.config import LateConfig, OverrideConfig
from curvelake.functions.scalars import conc_from_id, first_label
from curvelake.operators.evidence import checker_status
from curvelake.operators.grid import KEY


def ensemble(df: DataFrame, members: dict[str, float | None]) -> DataFrame:
    """Adds confidence_valid, pred_label, pred_confidence: a weighted vote of probability columns.

    members: column -> weight; equal weights if any is unknown.  A NULL probability leaves the vote and the
    other weights are scaled up; without any, the label is NULL.
    """
    weights = {c: (1.0 if any(w is None for w in members.values()) else float(w)) for c, w in members.items()}
    total = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()))
    p = reduce(lambda a, b: a + b, (F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items())) / F.nullif(total, F.lit(0.0))
    out = df.withColumn("confidence_valid", F.round(p, 4)).withColumn("_p", p)
    return out.withColumn("pred_label", F.when(F.col("_p") >= 0.5, "Valid").when(F.col("_p").isNotNull(), "Invalid")).withColumn("pred_confidence", F.round(F.greatest("_p", 1 - F.col("_p")), 4)).drop("_p")


def low_confidence(p: Column, threshold: float = 0.30) -> Column:
    """True between threshold and 1 - threshold."""
    return F.coalesce(F.least(p, 1 - p) > threshold + 1e-9, F.lit(False))


def assign_labels(df: DataFrame, late: LateConfig = LateConfig(), cfg: OverrideConfig = OverrideConfig()) -> DataFrame:
    """df: votes joined with evidence.  Low confidence wins over a contradiction, that over the stage-1 label."""
    status, code = checker_status(F.coalesce("pred_label", F.lit("")), late)
    shaky = low_confidence(F.col("confidence_valid"), cfg.low_confidence)
    named = F.coalesce("pred_label", F.lit("Unknown"))
    text = lambda head, p: F.concat(head, F.lit(": Confidence("), named, F.lit(") = "), F.coalesce(F.format_string("%.2f", p), F.lit("nan")))
    contra = F.col("stage2_label") == "Contradiction"
    out = df.withColumn("stage2_label", status).withColumn("_code", code)
    return (
        out.withColumn("label_reason", F.when(shaky, text(F.lit("S1_LOW_CONFIDENCE"), F.col("confidence_valid"))).when(contra, text(F.col("_code"), F.col("pred_confidence"))).otherwise(F.col("_code")))
        .withColumn("final_label", F.when(shaky | contra, "Unsure").otherwise(F.coalesce("pred_label", F.lit("Unsure"))))
        .drop("_code")
    )


def missing_features(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in columns)) / float(len(columns))


def apply_overrides(df: DataFrame, features: list[str], cfg: OverrideConfig = OverrideConfig()) -> DataFrame:
    """Gaps, then missing features, then sparseness turn the final label to Unsure; the last reason wins."""
    gap = F.coalesce((F.col("max_gap_hours") > cfg.max_gap_hours) | (F.col("missing_frac_on_grid") > cfg.max_missing), F.lit(False))
    sparse = F.coalesce(F.col("too_sparse").cast("int") == 1, F.lit(False))
    lacking = missing_features(features) > cfg.max_feature_missing
    reason = F.when(sparse, "TOO_SPARSE_OVERRIDE").when(lacking, "FEATURE_COMPLETENESS_OVERRIDE").when(gap, "OUT_OF_DISTRIBUTION_GAP_OVERRIDE").otherwise(F.col("label_reason"))
    return df.withColumn("label_reason", reason).withColumn("final_label", F.when(gap | lacking | sparse, "Unsure").otherwise(F.col("final_label")))


def eligible(df: DataFrame, include_unsure: bool = False, include_invalid: bool = False, column: str = "final_label") -> DataFrame:
    """Rows whose curves go into fits."""
    return df.where(F.col(column).isin(["Valid", *["Unsure"] * include_unsure, *["Invalid"] * include_invalid]))


def by_label(df: DataFrame, wanted: str = "All", column: str = "final_label") -> DataFrame:
    return df if wanted == "All" else df.where(F.col(column) == wanted)


def validity_join(obs: DataFrame, labels: DataFrame, small: int = 1_000_000) -> DataFrame:
    """Observations with is_valid_final; curves without a label count as not valid.  Spark picks the join by size."""
    one = labels.groupBy(KEY).agg(F.max((F.col("final_label") == "Valid").cast("int")).alias("_v"))
    return obs.join(one, KEY, "left").withColumn("is_valid_final", F.coalesce(F.col("_v") == 1, F.lit(False))).drop("_v")


def review_table(labels: DataFrame) -> DataFrame:
    return labels.select(KEY, "pred_label", "final_label", F.col("final_label").alias("true_label"), F.lit(False).alias("reviewed"))


def audit_table(curves: DataFrame, labels: DataFrame, feats: DataFrame, processed: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """Curves with labels, features, the processed series (an array) and the reviewer's label, which wins where given."""
    series = processed.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("time_h", "od"))).alias("processed"))
    out = curves.join(labels, KEY, "left").join(feats.drop(*[c for c in feats.columns if c != KEY and c in labels.columns]), KEY, "left").join(series, KEY, "left")
    if review is not None:
        out = out.join(review.select(KEY, F.col("true_label").alias("review_label"), F.col("reviewed").alias("_r")), KEY, "left")
        shown = F.when(F.col("_r"), F.col("review_label"))
    else:
        shown = F.lit(None).cast("string")
    return out.withColumn("true_label", first_label(shown, F.col("final_label"), F.col("pred_label"))).drop("_r", "review_label")


#: Columns of the predictions that stand beside a review; fixed values.
PREDICTION_COLUMNS = ["pred_label", "pred_confidence", "confidence_valid", "confidence_invalid", "too_sparse"]


def review_curves(out: DataFrame, review: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """The curves to choose from: those of the review with the predictions' columns, or without a review all predicted ones.

    A column that both have comes from the review.  A reviewed curve without a prediction stays, with nulls, and a null
    key has none; of several predictions of a curve the smallest row is taken.  Where there is no concentration column,
    the one within the key is read.
    """
    shown = out
    if review is not None:
        wanted = [c for c in PREDICTION_COLUMNS if c in out.columns and c not in review.columns]
        one = out.groupBy(key).agg(F.min(F.struct(*wanted)).alias("_p")).select(key, "_p.*") if wanted else None
        shown = review if one is None else review.join(one, key, "left")
    return shown if "concentration" in shown.columns else shown.withColumn("concentration", conc_from_id(F.col(key)))


def review_counts(labels: DataFrame, review: DataFrame) -> DataFrame:
    """One row: curves, those reviewed, and those of them whose reviewed label is the predicted one."""
    joined = labels.select(KEY, "pred_label").join(review.select(KEY, "reviewed", "true_label"), KEY, "left")
    seen = F.coalesce("reviewed", F.lit(False))
    return joined.agg(F.count("*").alias("n_curves"), F.count(F.when(seen, 1)).alias("n_reviewed"), F.count(F.when(seen & (F.col("true_label") == F.col("pred_label")), 1)).alias("n_correct"))


def attach_validity(tidy: DataFrame, predictions: DataFrame, default: bool = False) -> DataFrame:
    """Tidy points (test_id, curve_id) with is_valid of a prediction map; curves without a prediction get the default."""
    return tidy.join(predictions.select("test_id", "curve_id", F.col("is_valid").alias("_v")), ["test_id", "curve_id"], "left").withColumn("is_valid", F.coalesce("_v", F.lit(default))).drop("_v")


def label_counts(df: DataFrame, column: str = "final_label") -> DataFrame:
    return df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))


def fit_input(curves: DataFrame, audit: DataFrame) -> DataFrame:
    """Curves with the audit's label by id and concentration; an unknown concentration matches an unknown one."""
    a = audit.select(F.col("curve_id").alias("_id"), F.col("concentration").alias("_c"), "true_label")
    return curves.join(a, F.col("curve_id").eqNullSafe(F.col("_id")) & F.col("concentration").eqNullSafe(F.col("_c")), "left").drop("_id", "_c")


def duplicates(curves: DataFrame, column: str = "curve_id", most: int = 5) -> list[str]:
    """Ids that occur twice or more, a few of them for an error message."""
    return [r[0] for r in curves.groupBy(column).count().where("count > 1").orderBy(column).limit(most).collect()]
