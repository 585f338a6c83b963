"""Command line: python -m curvelake.cli synth | build-train-meta | train | label."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from curvelake.functions.scalars import curve_key
from curvelake.ml import classifier
from curvelake.plans import analysis
from curvelake.sinks import read_table, write_ordered_csv, write_tables
from curvelake.sources import readers
from curvelake.sources.synthetic import synthetic_curves


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="curvelake")
    sub = p.add_subparsers(dest="what", required=True)
    s = sub.add_parser("synth", help="labelled synthetic curves")
    s.add_argument("out")
    s.add_argument("--n", type=int, default=900)
    s.add_argument("--seed", type=int, default=123)
    s = sub.add_parser("build-train-meta", help="labelled wide files to raw_merged, final_merged and training_meta")
    s.add_argument("out")
    s.add_argument("files", nargs="+")
    s.add_argument("--csv", action="store_true", help="ordered CSV instead of Parquet")
    s = sub.add_parser("train", help="the folder of build-train-meta to models")
    s.add_argument("table")
    s.add_argument("out")
    s = sub.add_parser("label", help="a plate file to labelled curves")
    s.add_argument("file")
    s.add_argument("models")
    s.add_argument("out")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.what == "synth":
        synthetic_curves(spark, a.n, seed=a.seed).write.mode("overwrite").parquet(a.out)
    elif a.what == "build-train-meta":
        long = readers.read_training(spark, a.files)
        long = long.withColumn("curve_key", F.concat_ws("_", "file_name", curve_key(F.col("curve_id"), F.col("concentration"))))
        tables = analysis.training_stages(long.select("curve_key", "is_valid", "time_h", "od"))
        if a.csv:
            for name, df in tables.items():
                write_ordered_csv(df, f"{a.out}/{name}", ["curve_key"])
        else:
            write_tables(tables, a.out)
    elif a.what == "train":
        classifier.save(classifier.train(read_table(spark, f"{a.table}/training_meta")), a.out, spark)
    else:
        analysis.label_curves(readers.read_any(spark, a.file), classifier.load(a.models, spark)).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
