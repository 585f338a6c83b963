"""Sinks: Parquet tables, ordered CSV files, zipped exports, run records."""

from __future__ import annotations

import io
import json
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dotted names of the export's columns.
EXPORT_NAMES = {"mu": "mu.spline", "lag": "lambda.spline", "a": "A.spline", "integral": "integral.spline", "mu_lo": "mu.ci.lo", "mu_hi": "mu.ci.hi", "ec50": "EC50", "y_ec50": "y.EC50", "crossing_rate": "EC50.crossing_rate"}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through the Hadoop file system of its path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Written:
    """Tables that a job writes on its way, in the folder of spark.checkpoint.dir; they go when the block ends.

    A written table cuts the lineage and outlives a lost executor.  Only a local session without that setting
    (tests) gets a folder of its own.
    """

    def __init__(self, spark: SparkSession, name: str):
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            top = f"file://{tempfile.mkdtemp(prefix='curvelake-')}"
            spark.conf.set("spark.checkpoint.dir", top)
        self.spark, self.path = spark, f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        delete(self.spark, f"{self.path}/{name}".rstrip("/"))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.drop()


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


# archives: tasks sort, write and compress; what is left for the one who holds the file is to append


#: Characters of CSV text that are compressed at once.
_CHUNK = 1 << 22


@cache
def _zero_bytes(power: int) -> tuple[int, ...]:
    """What 2**power zero bytes make of each bit of a CRC-32 register."""
    if not power:
        return tuple(zlib.crc32(b"\0", (1 << bit) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for bit in range(32))
    return tuple(_linear(_zero_bytes(power - 1), c) for c in _zero_bytes(power - 1))


def _linear(columns: tuple[int, ...], x: int) -> int:
    out = 0
    for bit, c in enumerate(columns):
        if x >> bit & 1:
            out ^= c
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings, one after the other, from both CRCs and the second one's length."""
    for power in range(length.bit_length()):
        if length >> power & 1:
            first = _linear(_zero_bytes(power), first)
    return first ^ second


def _flat(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if not t.startswith(("array", "struct", "map"))]


def csv_pieces(df: DataFrame, order: list[str]) -> DataFrame:
    """A table's CSV lines in order, as deflated pieces that any number of tasks make: part, place, data, crc, size, n_rows.

    Each piece ends at a byte and needs none before it, so pieces only have to be put one after the other.
    """
    flat = _flat(df)
    lines = F.to_csv(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(flat))), {"escape": '"'})
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select(lines.alias("line"), F.spark_partition_id().alias("part"))

    def run(batches):
        held, size, place, part = [], 0, 0, 0

        def piece():
            text = ("\n".join(held) + "\n").encode()
            squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = squeeze.compress(text) + squeeze.flush(zlib.Z_FULL_FLUSH)
            columns = (pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([data], pa.binary()), pa.array([zlib.crc32(text)], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([len(held)], pa.int64()))
            return pa.RecordBatch.from_arrays(list(columns), names=["part", "place", "data", "crc", "size", "n_rows"])

        for batch in batches:
            for line in batch.column(0).to_pylist():
                held.append(line)
                size += len(line)
                if size >= _CHUNK:
                    part = batch.column(1)[0].as_py()
                    yield piece()
                    held, size, place = [], 0, place + 1
            part = batch.column(1)[0].as_py() if len(batch) else part
        if held:
            yield piece()

    return ordered.mapInArrow(run, "part int, place int, data binary, crc long, size long, n_rows long")


class Archive:
    """A zip file that grows by appending (zip64, sizes after the data), so it can be written to any stream."""

    def __init__(self, write: Callable[[bytes], object]):
        self.write, self.at, self.entries = write, 0, []

    def _put(self, data: bytes) -> None:
        self.write(data)
        self.at += len(data)

    def member(self, name: str, pieces) -> int:
        """Appends a member of (deflated piece, crc, size, rows); returns its rows."""
        raw, offset, crc, size, packed, rows = name.encode(), self.at, 0, 0, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 8, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra)
        for data, piece_crc, length, n in pieces:
            self._put(bytes(data))
            crc, size, packed, rows = joined_crc(crc, piece_crc, length), size + length, packed + len(data), rows + n
        self._put(b"\x03\x00")  # an empty last block
        packed += 2
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, packed, size))
        self.entries.append((raw, crc, packed, size, offset))
        return rows

    def text(self, name: str, text: str) -> None:
        raw, squeeze = text.encode(), zlib.compressobj(6, zlib.DEFLATED, -15)
        self.member(name, [(squeeze.compress(raw) + squeeze.flush(zlib.Z_FULL_FLUSH), zlib.crc32(raw), len(raw), 0)])

    def close(self) -> None:
        start = self.at
        for raw, crc, packed, size, offset in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, packed, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        end, n = self.at, len(self.entries)
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, end - start, start))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1) + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def _export(tables: dict[str, DataFrame], run: dict, write: Callable[[bytes], object], order: dict[str, list[str]] | None) -> None:
    archive, manifest = Archive(write), []
    for name, df in tables.items():
        by = (order or {}).get(name) or [c for c in ("curve_key", "test_id", "parameter") if c in df.columns] or df.columns[:1]
        header = ",".join(EXPORT_NAMES.get(c, c) for c in _flat(df)) + "\n"
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        first = (squeeze.compress(header.encode()) + squeeze.flush(zlib.Z_FULL_FLUSH), zlib.crc32(header.encode()), len(header.encode()), 0)
        with Written(df.sparkSession, "export") as files:  # pieces outlive executors while they are fetched, some at a time
            pieces = files.write("pieces", csv_pieces(df, by)).orderBy("part", "place")
            rows = archive.member(f"{name}.csv", (x for part in ([first], ((r.data, r.crc, r.size, r.n_rows) for r in pieces.toLocalIterator())) for x in part))
        manifest.append(f"{name},{rows}")
    archive.text("manifest.csv", "table,rows\n" + "\n".join(manifest) + "\n")
    archive.text("run_info.json", json.dumps(run, indent=1, default=str))
    archive.close()


def write_archive(spark: SparkSession, path: str, tables: dict[str, DataFrame], run: dict, order: dict[str, list[str]] | None = None) -> None:
    """Tables as ordered CSV members of one zip file, a manifest and the run's record, on any file system Spark knows.

    Tasks sort, write and compress the rows; here only finished pieces are appended, a partition of them at a time, so
    tables may have any number of rows.  ``order``: columns that a table is sorted by, else its key.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        _export(tables, run, lambda data: out.write(bytearray(data)), order)
    finally:
        out.close()


def zip_export(tables: dict[str, DataFrame], run: dict, order: dict[str, list[str]] | None = None) -> bytes:
    """The archive of ``write_archive`` as bytes, for a download: compressed, it has to fit the memory here."""
    raw = io.BytesIO()
    _export(tables, run, raw.write, order)
    return raw.getvalue()


def write_ordered_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A folder of CSV parts whose rows are in order, within and across parts; any number of tasks write them."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_tables`` or ``write_ordered_csv`` wrote: Parquet, or texts from CSV."""
    names = [s.getPath().getName() for s in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))]
    if any(n.endswith(".csv") for n in names):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    """One more JSON line in the run log."""
    spark.createDataFrame([(json.dumps(run, default=str),)], "value string").coalesce(1).write.mode("append").text(path)
