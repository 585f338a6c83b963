"""Curve classifiers: logistic regression of pyspark.ml, a balanced forest and histogram boosting, and their weighted vote.

The linear model and the forest see medians and indicators in place of missing values; boosting learns which side
of each split they take.
"""

from __future__ import annotations

import json
import platform
from importlib import metadata

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.config import FEATURE_POOL, SELECTED_FEATURES, SLICES
from curvelake.functions.scalars import finite, label_of
from curvelake.ml import trees as T
from curvelake.operators import metrics
from curvelake.operators.labels import ensemble
from curvelake.sinks import Written, delete, write_text

#: Thresholds that go with a model set.
THRESHOLDS = {"valid": 0.70, "invalid": 0.30}


def model_matrix(meta: DataFrame, label: str = "is_valid", features: list[str] = SELECTED_FEATURES, group: str = "base_curve_id", pool: list[str] = FEATURE_POOL, keep: list[str] = ()) -> DataFrame:
    """group, y, the features as doubles (infinite: NULL) and the columns of ``keep``; rows without a known label go.

    The table must have the whole pool of candidate features, so that a subset chosen later can be trained from it.
    """
    missing = [c for c in dict.fromkeys([*pool, *features]) if c not in meta.columns]
    if missing:
        raise ValueError(f"features are missing: {missing}")
    y = F.when(label_of(F.col(label)) == "Valid", 1.0).when(label_of(F.col(label)) == "Invalid", 0.0)
    return meta.select(F.col(group).alias("group"), y.alias("y"), *(finite(F.col(c).cast("double")).alias(c) for c in features), *(F.col(c).alias(f"slice_{c}") for c in keep)).where("y is not null")


def summary(train: DataFrame, features: list[str]) -> tuple[dict[str, float], dict[float, int]]:
    """Exact medians of what is known (0 for a feature that never is) and rows by class, in one aggregate."""
    row = train.agg(*(F.percentile(c, 0.5).alias(c) for c in features), *(F.count(F.when(F.col("y") == y, 1)).alias(f"_n{y}") for y in (0, 1))).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in features}, {float(y): row[f"_n{y}"] for y in (0, 1)}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Each feature filled, and <feature>_missing beside it."""
    return df.select("*", *(F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in values)).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in values.items()})


def fit_linear(df: DataFrame, features: list[str], rows: int) -> PipelineModel:
    """Standardised features; the penalty of one against the summed loss of all rows."""
    vector = VectorAssembler(inputCols=[*features, *(f"{c}_missing" for c in features)], outputCol="raw_features")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=500, regParam=1 / max(rows, 1), standardization=False)
    return Pipeline(stages=[vector, scale, model]).fit(df)


def probabilities(df: DataFrame, model: PipelineModel | T.Ensemble, name: str, features: list[str]) -> DataFrame:
    """df with p_<name>; intermediate columns go, so models chain in one pass.

    df has the features filled and, beside them, <feature>_missing; boosting takes them back to NULL.
    """
    if isinstance(model, T.Ensemble):
        if model.kind == "boosting":
            blank = df.withColumns({f"_raw_{c}": F.when(F.col(f"{c}_missing") == 0, F.col(c)) for c in features})
            return blank.withColumn(f"p_{name.lower()}", model.probability([f"_raw_{c}" for c in features])).drop(*(f"_raw_{c}" for c in features))
        return df.withColumn(f"p_{name.lower()}", model.probability())
    out = model.transform(df).withColumn(f"p_{name.lower()}", vector_to_array("probability")[1])
    return out.drop("raw_features", "features", "rawPrediction", "probability", "prediction")


def train(meta: DataFrame, features: list[str] = SELECTED_FEATURES, seed: int = 42, trees: int = 600, boosts: int = 100, label: str = "is_valid", group: str = "base_curve_id") -> dict:
    """Splits by group 60/20/20, fits, measures: models, medians, weights (validation balanced accuracy), metrics.

    metrics: a row per model, split and slice (overall, and each value of SLICES that has five rows or more).  The
    table is computed once and written; class counts and medians are one aggregate, the metrics of all models another.
    """
    slices = [c for c in SLICES if c in meta.columns]
    with Written(meta.sparkSession, "train") as files:
        data = files.write("matrix", metrics.group_split(files.write("rows", model_matrix(meta, label, features, group, keep=slices)), "group", seed))
        if metrics.leaking_groups(data, "group").limit(1).count():
            raise ValueError("a group stands in more than one split")
        fill, counts = summary(data.where("split = 'train'"), features)
        rows, classes = sum(counts.values()), sum(n > 0 for n in counts.values())
        if classes < 2:
            raise ValueError("the training rows have one class only")
        weight = F.when(F.col("y") == 1, rows / (classes * counts[1.0])).otherwise(rows / (classes * counts[0.0]))
        ready = impute(data, fill).withColumn("weight", weight)
        fitted = ready.where("split = 'train'")
        inputs = [*features, *(f"{c}_missing" for c in features)]
        models = {
            "LR": fit_linear(fitted, features, rows),
            "RF": T.fit_forest(fitted, inputs, ["group", *inputs], trees=trees, seed=seed),
            "HGB": T.fit_boosting(data.where("split = 'train'").withColumn("weight", weight), features, weight="weight", rounds=boosts),
        }
        scored = ready
        for name, model in models.items():
            scored = probabilities(scored, model, name, features)
        scored = files.write("scored", scored)
        own = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.col(f"p_{n.lower()}").alias("p")) for n in models)))
        as_text = lambda c: (F.round(F.col(f"slice_{c}"), 3) if c == "train_horizon" else F.col(f"slice_{c}")).cast("string")
        cut = F.explode(F.array(F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("slice_value")), *(F.struct(F.lit(c).alias("slice"), as_text(c).alias("slice_value")) for c in slices)))
        each = scored.withColumn("own", own).withColumn("cut", cut).select("own.model", "split", "cut.slice", "cut.slice_value", F.col("y").cast("int").alias("y"), "own.p", (F.col("own.p") >= 0.5).cast("int").alias("predicted"))
        by = ["model", "split", "slice", "slice_value"]
        each = each.where("slice_value is not null")
        rates = metrics.with_rates(metrics.confusion(each, by)).where("n >= 5").join(metrics.roc_auc(each, by), by).join(metrics.average_precision(each, by), by)
        found = [r.asDict() for r in rates.collect()]
    weights = {r["model"]: r["balanced_accuracy"] for r in found if r["split"] == "val" and r["slice"] == "overall"}
    return {"models": models, "medians": fill, "weights": weights, "metrics": found, "features": features}


def predict(df: DataFrame, trained: dict, only: str = "Average") -> DataFrame:
    """Adds p_lr, p_rf, p_hgb, confidence_valid, pred_label, pred_confidence; the vote of all, or of the one model named."""
    out = impute(df.withColumns({c: finite(F.col(c).cast("double")) for c in trained["features"]}), trained["medians"])
    for name, model in trained["models"].items():
        out = probabilities(out, model, name, trained["features"])
    only = model_name(only)
    voters = [only] if only in trained["models"] else list(trained["models"])
    out = ensemble(out, {f"p_{n.lower()}": trained["weights"].get(n) for n in voters})
    return out.drop(*(f"{c}_missing" for c in trained["features"]))


def split_stability(meta: DataFrame, seeds: list[int], **options) -> DataFrame:
    """Test metrics over several splits, summarised."""
    rows = [{k: float(v) if isinstance(v, (int, float)) else v for k, v in r.items() if v is not None} for s in seeds for r in train(meta, seed=s, **options)["metrics"] if r["split"] == "test" and r["slice"] == "overall"]
    names = ["balanced_accuracy", "precision", "recall", "f1"]
    runs = meta.sparkSession.createDataFrame([[r["model"], *(r[n] for n in names)] for r in rows], ["model", *names])
    return metrics.stability(runs, names)


def save(trained: dict, path: str, spark: SparkSession) -> None:
    """Each model as a folder, the metrics as CSV, the packages in use and one manifest, through Spark's file systems.

    Models of an earlier set that this one doesn't have go.  The manifest goes last and is taken away first: a set
    without one is being written and isn't loaded.
    """
    delete(spark, f"{path}/manifest.json")
    for name in {"LR", "RF", "HGB"} | set(trained["models"]):
        delete(spark, f"{path}/{name}")
    names = list(dict.fromkeys(k for r in trained["metrics"] for k in r))
    lines = [",".join("" if r.get(k) is None else str(r[k]) for k in names) for r in trained["metrics"]]
    write_text(spark, f"{path}/train_metrics.csv", "\n".join([",".join(names), *lines]) + "\n")
    packages = sorted({f"{d.metadata['Name']}=={d.version}" for d in metadata.distributions() if d.metadata["Name"]}, key=str.lower)
    write_text(spark, f"{path}/environment.lock.txt", "\n".join([f"python=={platform.python_version()}", *packages]) + "\n")
    kinds = {}
    for name, model in trained["models"].items():
        kinds[name] = "trees" if isinstance(model, T.Ensemble) else "pipeline"
        model.save(spark, f"{path}/{name}") if kinds[name] == "trees" else model.write().overwrite().save(f"{path}/{name}")
    manifest = {"models": kinds, "features": trained["features"], "medians": trained["medians"], "weights": trained["weights"], "metrics": trained["metrics"], "thresholds": THRESHOLDS, "spark": spark.version}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1, default=str))


def load(path: str, spark: SparkSession) -> dict:
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect()))
    if manifest["spark"].split(".")[0] != spark.version.split(".")[0]:
        raise ValueError(f"models were saved by Spark {manifest['spark']}, this is {spark.version}")
    of = lambda name, kind: T.Ensemble.load(spark, f"{path}/{name}") if kind == "trees" else PipelineModel.load(f"{path}/{name}")
    return manifest | {"models": {name: of(name, kind) for name, kind in manifest["models"].items()}}


#: Spellings of the models' names in files and choices.
MODEL_NAMES = {"lr": "LR", "logreg": "LR", "logistic_regression": "LR", "rf": "RF", "random_forest": "RF", "randomforest": "RF", "hgb": "HGB", "hist_gradient_boosting": "HGB", "histgradientboosting": "HGB"}


def model_name(text: str) -> str:
    """The name of a model by any of its spellings (letter case, blanks and dashes aside); others stay as they are."""
    return MODEL_NAMES.get(text.strip().lower().replace("-", "_").replace(" ", "_"), text)


def discover(root: str, spark: SparkSession) -> dict[str, str]:
    """Complete model sets in the folders under ``root``: name of the folder to its path, newest first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in fs.listStatus(top) if fs.exists(top) else []:
        manifest = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "manifest.json")
        if entry.isDirectory() and fs.exists(manifest):
            found.append((-fs.getFileStatus(manifest).getModificationTime(), entry.getPath().getName(), entry.getPath().toString()))
    return {name: path for _, name, path in sorted(found)}
