"""Synthetic labelled curves over spark.range, and small sample files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curvelake.config import GridConfig
from curvelake.kernels.synthetic import SET_SIZE, curves, plan


def synthetic_curves(spark: SparkSession, n: int = SET_SIZE, cfg: GridConfig = GridConfig(), noise: float = 0.05, seed: int = 123, partitions: int | None = None, stem: str = "syn") -> DataFrame:
    """curve_key, model_name, subtype, is_valid, time_h, od (long); each curve depends on seed and index alone.

    A set has 900 curves, 503 of them valid, of subtypes in fixed numbers; more curves are further such sets.
    """
    points, cards = cfg.points, plan(seed)
    schema = "curve_key string, model_name string, subtype string, is_valid boolean, time_h double, od double"

    def run(batches):
        t = np.arange(points) * cfg.step
        for batch in batches:
            for k in range(0, len(batch), 512):
                index = batch.column(0)[k : k + 512].to_numpy()
                dealt = [cards[i % SET_SIZE] for i in index]
                family, y = curves([kind for _, kind in dealt], index, t, noise, seed)
                row, place = np.nonzero(np.isfinite(y))
                of = lambda values, row=row: pa.array(values).take(pa.array(row))
                columns = [of([f"{stem}_{i + 1}" for i in index]), of(family), of([kind for _, kind in dealt]), of([valid for valid, _ in dealt]), pa.array(t[place]), pa.array(y[row, place])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    ids = spark.range(n) if partitions is None else spark.range(0, n, 1, partitions)
    return ids.mapInArrow(run, schema)


def sample_wide(spark: SparkSession) -> DataFrame:
    """Six wells with doses 0 to 10 at half-hour steps to 8 h, as a wide table."""
    from curvelake.kernels.growth import logistic
    from curvelake.operators.reshape import header_of_time

    t = np.arange(17) * 0.5
    rows = [[f"A0{i + 1}", dose, *map(float, logistic(t, 0.05, 1.2 / (1 + dose), 0.4, 2.0))] for i, dose in enumerate([0.0, 0.1, 0.3, 1.0, 3.0, 10.0])]
    return spark.createDataFrame(rows, ["Test Id", "concentration", *(header_of_time(float(x)) for x in t)])


def sample_long(spark: SparkSession) -> DataFrame:
    """A time column and six wells with their doses in the names."""
    from curvelake.kernels.growth import logistic

    t = np.arange(13) * 1.0
    doses = [0.0, 0.1, 0.3, 1.0, 3.0, 10.0]
    columns = [logistic(t, 0.05, 1.2 / (1 + d), 0.4, 2.0) for d in doses]
    return spark.createDataFrame([[float(x), *(float(c[i]) for c in columns)] for i, x in enumerate(t)], ["Time (h)", *(f"A0{i + 1}[Conc={d}]" for i, d in enumerate(doses))])
