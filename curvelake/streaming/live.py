"""Running statistics of curves whose points arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_stats(stream: DataFrame, time_col: str = "arrived", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Per curve and window of arrival: points, span, largest value and mean, over a streaming (or static) table.

    The watermark bounds the state to curves seen within ``late`` of the newest point.
    """
    clean = stream.where("time_h is not null and od is not null").withWatermark(time_col, late)
    return clean.groupBy(F.window(time_col, window), "curve_key").agg(F.count("*").alias("n_points"), (F.max("time_h") - F.min("time_h")).alias("span"), F.max("od").alias("max_od"), F.avg("od").alias("mean_od"))
