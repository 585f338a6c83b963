"""Wide and long forms of curves, and the codec of time headers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions.scalars import conc_from_id, curve_key, finite, number

_HEADER = re.compile(r"^\s*T?\s*([0-9]+(?:\.[0-9]+)?)\s*\(?\s*(?:h|hours)\s*\)?\s*$", re.I)

#: Spellings of the concentration column, in order of preference.
CONC_NAMES = ["concentration", "conc", "dose", "drug_conc"]


def time_of_header(name: str) -> float | None:
    """0.5 for ``T0.5 (h)``, ``t 0.5(h)``, ``T0.5 (hours)`` and ``0.5 h``."""
    m = _HEADER.match(name)
    return float(m[1]) if m else None


def header_of_time(t: float) -> str:
    text = f"{t:.2f}".rstrip("0")
    return f"T{text + '0' if text.endswith('.') else text} (h)"


def time_columns(df: DataFrame) -> list[str]:
    found = [(t, c) for c in df.columns if (t := time_of_header(c)) is not None]
    return [c for _, c in sorted(found)]


def find_column(columns: list[str], names: list[str]) -> str | None:
    folded = {c.strip().lower(): c for c in reversed(columns)}
    return next((folded[n] for n in names if n in folded), None)


def wide_to_long(wide: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """ids, time_h, od; every time column becomes rows, cells that are no numbers go."""
    times = time_columns(wide)
    ids = ids if ids is not None else [c for c in wide.columns if c not in times]
    quoted = [F.col(f"`{c}`") for c in ids]
    long = wide.select(*quoted, *(number(F.col(f"`{c}`")).alias(c) for c in times)).unpivot(quoted, [F.col(f"`{c}`") for c in times], "_column", "od")
    at = F.create_map(*(x for c in times for x in (F.lit(c), F.lit(time_of_header(c)))))
    return long.select(*quoted, at[F.col("_column")].alias("time_h"), "od").where("od is not null")


def long_to_wide(obs: DataFrame, keys: list[str], tag: str | None = None, times: list[float] | None = None) -> DataFrame:
    """One row per curve and a column per time; the means of repeated times.  Curves of unknown concentration stay.

    Without ``times`` the columns are the times that occur; with them, a curve without any value there has NULLs.
    """
    known = obs.where("time_h is not null and od is not null")
    if times is None:
        times = [r[0] for r in known.select("time_h").distinct().orderBy("time_h").collect()]  # the columns of the result
    else:
        known = obs
    wide = known.groupBy(*keys).agg(*(F.avg(F.when(F.col("time_h") == t, F.col("od"))).alias(header_of_time(t)) for t in times))
    return wide.withColumn(keys[0], F.concat(F.lit(f"{tag}_"), F.col(keys[0]))) if tag else wide


def standardize_long(long: DataFrame, stem: str) -> DataFrame:
    """The fixed schema of observations: defaults filled, numbers coerced, negative times dropped."""
    have = {c.lower(): c for c in long.columns}
    pick = lambda name, default: F.col(f"`{have[name]}`") if name in have else default
    curve = pick("curve_id", F.lit(None)).cast("string")
    conc = number(F.col(f"`{c}`")) if (c := find_column(long.columns, CONC_NAMES)) else conc_from_id(curve)
    out = long.select(
        pick("file_name", F.lit(stem)).cast("string").alias("file_name"), curve.alias("curve_id"), F.coalesce(pick("model_name", F.lit(None)).cast("string"), curve).alias("model_name"),
        F.coalesce(pick("is_valid", F.lit(True)).cast("boolean"), F.lit(True)).alias("is_valid"), conc.alias("concentration"), number(pick("time_h", F.lit(None))).alias("time_h"), finite(number(pick("od", F.lit(None)))).alias("od"),
    )
    return out.where("time_h is not null and od is not null and time_h >= 0").withColumn("curve_key", curve_key(F.col("curve_id"), F.col("concentration")))


def fit_tidy(obs: DataFrame) -> DataFrame:
    """test_id, curve_id, concentration (unknown: 0), time, y: what the fits read."""
    return obs.where("od is not null").select(F.col("file_name").alias("test_id"), "curve_id", F.coalesce("concentration", conc_from_id(F.col("curve_id")), F.lit(0.0)).alias("concentration"), F.col("time_h").alias("time"), F.col("od").alias("y"))
