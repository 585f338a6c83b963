"""Readers of plate files: CSV dialects and workbooks, all to the long form (curve_id, time_h, od, ...).

Single files are read with their headers as text, cells are coerced in expressions.  Folders, many files and
workbooks are one binary scan (``sheets``), in which each task finds the layout of its files.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelake.functions.scalars import condition_of, duration_hours, lenient_bool, number, time_scale, well_of
from curvelake.operators.reshape import CONC_NAMES, find_column, standardize_long, time_columns, wide_to_long
from curvelake.sources.sheets import read_sheets, read_training_sheets

_TIME = re.compile(r"time|tiempo", re.I)


def stem_of(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def with_row_index(df: DataFrame, name: str) -> DataFrame:
    """Positions of the rows in file order, whatever the partitions: places within each one after the rows before it."""
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    before, total = {}, 0
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # a row per file split
        before[r["_part"]], total = total, total + r["count"]
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("_part")] if before else F.lit(0)
    return placed.withColumn(name, (F.col("_place") + offset).cast("long")).drop("_part", "_place")


def _first(df: DataFrame, names: list[str], default: Column) -> Column:
    found = find_column(df.columns, names)
    return F.col(f"`{found}`").cast("string") if found else default


def from_wide(df: DataFrame, stem: str) -> DataFrame:
    """A row per curve, ``T0.5 (h)`` columns.  Missing ids are row positions, a missing validity is true."""
    times = time_columns(df)
    named = find_column(df.columns, ["test id", "test_id"])
    if named is None or df.where(F.col(f"`{named}`").isNull()).limit(1).count():
        df = with_row_index(df, "_row")
    ix = F.concat(F.lit("row_"), F.col("_row").cast("string")) if "_row" in df.columns else F.lit(None).cast("string")
    own = df.select(
        F.coalesce(_first(df, ["filename", "file_name"], F.lit(stem)), F.lit(stem)).alias("file_name"), F.coalesce(_first(df, ["test id", "test_id"], ix), ix).alias("curve_id"),
        _first(df, ["model name", "model_name"], F.lit(None).cast("string")).alias("model_name"), F.coalesce(lenient_bool(_first(df, ["is_valid"], F.lit("true"))), F.lit(True)).alias("is_valid"),
        number(_first(df, CONC_NAMES, F.lit(None).cast("string"))).alias("_conc"), *(F.col(f"`{c}`") for c in times),
    )
    long = wide_to_long(own, ["file_name", "curve_id", "model_name", "is_valid", "_conc"])
    long = long.withColumnRenamed("_conc", "concentration") if find_column(df.columns, CONC_NAMES) else long.drop("_conc")
    return standardize_long(long, stem)


def time_hours(df: DataFrame, column: str, default_unit: str | None = None) -> DataFrame:
    """Adds time_h from a time column: mostly numbers are scaled by header hint or size, else durations are parsed."""
    cell = F.col(f"`{column}`")
    n = df.agg(F.count(number(cell)).alias("num"), F.count(cell).alias("all")).first()
    if n["all"] == 0:
        return df.withColumn("time_h", F.lit(None).cast("double"))
    if n["num"] <= 0.7 * n["all"]:
        return df.withColumn("time_h", duration_hours(cell))
    hint = column if re.search(r"sec|\[s|min|\[m|hour|hr|\[h|\(h\)", column, re.I) else (default_unit or "")
    distinct = df.select(number(cell).alias("t")).where("t is not null").distinct()
    per = distinct.withColumn("d", F.col("t") - F.lag("t").over(Window.orderBy("t"))).agg(F.percentile("d", 0.5).alias("step"), F.max("t").alias("top")).first()
    scale = time_scale(F.lit(hint), F.lit(per["step"]).cast("double"), F.lit(per["top"]).cast("double"))
    return df.withColumn("time_h", number(cell) * scale)


def from_time_table(df: DataFrame, stem: str, conc: dict[str, float] | None = None, default_unit: str | None = None) -> DataFrame | None:
    """A time column and a column per curve; columns of fewer than 2 numbers go.  None if no time can be read."""
    column = next((c for c in df.columns if _TIME.search(c)), df.columns[0])
    timed = time_hours(df, column, default_unit)
    values = [c for c in df.columns if c != column and not c.lower().startswith("reading")]
    counts = timed.agg(F.count("time_h").alias("_t"), *(F.count(number(F.col(f"`{c}`"))).alias(f"v{i}") for i, c in enumerate(values))).first()
    kept = [c for i, c in enumerate(values) if counts[f"v{i}"] >= 2]
    if not counts["_t"] or not kept:
        return None
    long = timed.select("time_h", *(number(F.col(f"`{c}`")).alias(c) for c in kept)).unpivot(["time_h"], [F.col(f"`{c}`") for c in kept], "_column", "od")
    well = well_of(F.col("_column"))
    long = long.withColumn("curve_id", F.coalesce(well, F.col("_column"))).withColumn("model_name", condition_of(F.col("_column")))
    if conc is not None:
        table = F.create_map(*(x for k, v in conc.items() for x in (F.lit(k), F.lit(float(v))))) if conc else None
        long = long.withColumn("concentration", F.coalesce(table[F.col("curve_id")], F.lit(0.0)) if table is not None else F.lit(0.0))
    return standardize_long(long.drop("_column"), stem)


def from_plate(df: DataFrame, stem: str) -> DataFrame | None:
    """Like a time table, in seconds unless the header says otherwise; ``condition (A01)`` columns."""
    column = next((c for c in df.columns if "avg" in c.lower() and "time" in c.lower()), next((c for c in df.columns if _TIME.search(c)), None))
    if column is None or not any(re.search(r"\([A-Z]\d{2}\)\s*$", c) for c in df.columns):
        return None
    return from_time_table(df.select(F.col(f"`{column}`"), *(F.col(f"`{c}`") for c in df.columns if c != column and not _TIME.search(c))), stem, default_unit="sec")


def from_v_columns(df: DataFrame, stem: str) -> DataFrame:
    """Columns V4 ... Vn at quarter hours; the id is Test_Id and V3."""
    values = sorted((c for c in df.columns if re.fullmatch(r"V\d+", c) and int(c[1:]) >= 4), key=lambda c: int(c[1:]))
    if find_column(df.columns, ["test_id", "testid", "test id", "id"]) is None:
        df = with_row_index(df, "_row")
    test = _first(df, ["test_id", "testid", "test id", "id", "_row"], F.lit(None).cast("string"))
    named = F.concat(test, F.lit("_C"), F.col("V3")) if "V3" in df.columns and find_column(df.columns, ["test_id"]) else test
    long = df.select(named.alias("curve_id"), *(number(F.col(c)).alias(c) for c in values)).unpivot(["curve_id"], values, "_v", "od")
    return standardize_long(long.withColumn("time_h", (F.substring("_v", 2, 9).try_cast("int") - 4) * 0.25).drop("_v"), stem)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_cells(content: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of all filled cells of an OOXML workbook."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        paths = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for sheet, path in zip(sheets, paths, strict=False):
            for c in ElementTree.fromstring(z.read(path)).iter(f"{_NS}c"):
                ref = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                v = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                if not ref or text is None:
                    continue
                column = 0
                for letter in ref[1]:
                    column = 26 * column + ord(letter) - 64
                out.append((sheet, int(ref[2]) - 1, column - 1, shared[int(text)] if c.get("t") == "s" else text))
    return out


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """All sheets that some layout fits, together; tasks open the files, from any store Spark reads."""
    long = read_sheets(spark, path)
    if not long.limit(1).count():
        raise ValueError(f"no sheet of {path} has a known layout")
    return long


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Picks a layout by the extension and the header; time headers are looked for before anything else.  A folder or glob is read whole."""
    if path.lower().endswith(".xls"):
        raise ValueError(f"{path} is a workbook of the old binary kind: save it as .xlsx")
    if path.lower().endswith(".xlsx"):
        return read_workbook(spark, path)
    if re.search(r"[*?\[{]", path) or _is_folder(spark, path):
        return read_sheets(spark, path)
    if not path.lower().endswith(".csv"):
        raise ValueError(f"unknown kind of file: {path}")
    df, stem = read_text_csv(spark, path), stem_of(path)
    if time_columns(df):
        return from_wide(df, stem)
    if any(re.fullmatch(r"V\d+", c) for c in df.columns):
        return from_v_columns(df, stem)
    long = from_time_table(df, stem)
    if long is None:
        raise ValueError(f"no known layout in {path}")
    return long


def read_training(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Labelled wide files, folders or globs, in one scan.  Files that aren't there are skipped."""
    there = [p for p in ([paths] if isinstance(paths, str) else paths) if re.search(r"[*?\[{]", p) or exists(spark, p)]
    if not there:
        raise ValueError("no training file")
    return read_training_sheets(spark, there)


def read_blank_status(spark: SparkSession, path: str) -> DataFrame:
    """file_name, status (RAW or ALREADY), blank_value."""
    df = read_text_csv(spark, path)
    word = F.lower(F.trim(_first(df, ["already_blank_subtracted", "status"], F.lit(None).cast("string"))))
    status = F.when(word.isin("already", "true", "yes", "1", "subtracted"), "ALREADY").when(word.isin("raw", "false", "no", "0"), "RAW")
    return df.select(_first(df, ["filename", "file_name"], F.lit(None).cast("string")).alias("file_name"), F.coalesce(status, F.raise_error(F.concat(F.lit("unknown blank status: "), F.coalesce(word, F.lit("none")))).cast("string")).alias("status"), number(_first(df, ["blank_value"], F.lit(None).cast("string"))).alias("blank_value"))


def prediction_map(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(test_id, curve_id, is_valid) from ``<test>_<curve>`` ids with a label or a confidence."""
    ident = _first(df, ["test id", "test_id"], F.lit(None).cast("string"))
    label = lenient_bool(_first(df, ["predicted label", "label"], F.lit(None).cast("string")))
    p = number(_first(df, ["confidence (valid)", "p_valid"], F.lit(None).cast("string")))
    return df.select(F.regexp_extract(ident, r"^(.*)_([^_]*)$", 1).alias("test_id"), F.regexp_extract(ident, r"^(.*)_([^_]*)$", 2).alias("curve_id"), F.coalesce(label, p >= threshold).alias("is_valid")).dropDuplicates(["test_id", "curve_id"])
