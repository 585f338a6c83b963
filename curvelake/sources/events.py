"""Curves from an event table: one per user, cumulated values against days, read as hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Doses by user.
DOSES = [0.0, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curve_key, test_id, concentration, time_h, od (cumulated, rounded), od_raw, event_id; one shuffle by user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 86400000000.0D")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    dose = F.get(F.array(*(F.lit(d) for d in DOSES)), F.col("user_id").cast("int") % 8)
    return e.select(
        F.concat(F.lit("U"), F.col("user_id")).alias("curve_key"), F.concat(F.lit("P"), F.col("user_id") % 5).alias("test_id"), dose.alias("concentration"),
        hours.alias("time_h"), F.round(F.sum("value").over(w) / 1000.0, 6).alias("od"), (F.col("value") / 100.0).alias("od_raw"), "event_id",
    )
