"""Importance resampling towards a target distribution, over hashed word n-grams.

A document's features are its runs of 1 to ``n_max`` consecutive words; a feature's bucket is the CRC-32 of its
UTF-8 bytes (words joined by one space) modulo ``n_buckets``.  Texts are written out separator-normalised, one
block at a time, and scanned once: running CRC registers are stored (``Prefixes``), and any n-gram's CRC
follows from the registers before and after it, as CRC is linear over GF(2): the earlier register, moved on by
the n-gram's length in zero bytes, cancels out.  No n-gram is ever built or hashed by itself.

A bucket's gain is the log ratio of its smoothed shares in target and documents; a document's weight the floored
mean of its features' gains; a Gumbel number from a hash of seed and id is added, and the documents of the
highest sums are drawn, which samples without replacement in proportion to exp(weight / 1000).

Bounds: tasks send ``n_buckets`` counts at most, and these come to the driver.  Scores are whole numbers between
about -90,000 and 110,000 (64-bit counts), so the driver sees a table of scores with 200,000 rows at most, never
documents; ranks are taken within single scores, which hold some 0.04 % of a weight's documents by the noise.

Cases: a null or empty text, or one without a word, has no features and weight 0.  Rows count as documents:
repeated rows are counted, scored alike and ranked one after the other; ties go to the smaller id, null ids last,
then by a hash of the text.  A null id is hashed as the empty string.  Empty documents or an empty target leave
smoothed shares only.  A text's memory is some 40 bytes a byte, of one block or longest text at a time.  Columns other than
id and text are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .scratch import Scratch

_U = np.uint32
_COLUMNS = 256


def _step(register: np.ndarray) -> np.ndarray:
    """The register one zero byte later."""
    return _byte_table()[register & _U(0xFF)] ^ (register >> _U(8))


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=_U)
    for _ in range(8):
        table = np.where(table & _U(1), (table >> _U(1)) ^ _U(0xEDB88320), table >> _U(1))
    return table


def _apply(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by what it makes of each byte at each of four places."""
    return tables[0][register & _U(0xFF)] ^ tables[1][(register >> _U(8)) & _U(0xFF)] ^ tables[2][(register >> _U(16)) & _U(0xFF)] ^ tables[3][register >> _U(24)]


@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """The map of 2**power zero bytes."""
    if not power:
        return np.stack([_step(np.arange(256, dtype=_U) << _U(8 * k)) for k in range(4)])
    half = _zeros(power - 1)
    return np.stack([_apply(half, half[k]) for k in range(4)])


def shift(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n further zero bytes each."""
    out, n = register.copy(), np.asarray(n)
    for power in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> power & 1)
        out[at] = _apply(_zeros(power), out[at])
    return out


class Prefixes:
    """Running CRC registers of a byte string, from 0, for every position.

    The string is cut into rows of 256 bytes that are scanned side by side; the registers at row ends are then
    added up by doubling, so the whole takes a fixed number of array operations and a logarithm of them.
    """

    def __init__(self, data: np.ndarray):
        rows = len(data) // _COLUMNS + 1
        padded = np.zeros(rows * _COLUMNS, dtype=np.uint8)
        padded[: len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(rows, _COLUMNS).T)
        table, register = _byte_table(), np.zeros(rows, dtype=_U)
        self.inside = np.empty((_COLUMNS, rows), dtype=_U)
        for k in range(_COLUMNS):
            self.inside[k] = register
            register = table[(register ^ columns[k]) & _U(0xFF)] ^ (register >> _U(8))
        power = _COLUMNS.bit_length() - 1
        step = 1
        while step < rows:  # register[i] covers the last 2 * step rows afterwards
            register[step:] ^= _apply(_zeros(power), register[:-step])
            step, power = 2 * step, power + 1
        self.before = np.concatenate([[_U(0)], register[:-1]]).astype(_U)

    def at(self, position: np.ndarray) -> np.ndarray:
        row, column = np.divmod(position, _COLUMNS)
        return self.inside[column, row] ^ shift(self.before[row], column)

    def crc32(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of each byte span."""
        return ~(self.at(end) ^ shift(~self.at(start), end - start))


def buckets_of(block: T.Block, n_max: int, n_buckets: int) -> tuple[T.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of a block, and per n the bucket of each n-gram next to the text it belongs to."""
    words = block.words(T.ALNUM)
    data, start, end, _ = T.joined(block, words)
    prefixes, found = Prefixes(data), []
    for n in range(1, n_max + 1):
        m = max(len(start) - n + 1, 0)
        first = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
        found.append((prefixes.crc32(start[first], end[first + n - 1]) % _U(n_buckets), words.doc[first]))
    return words, found


def bucket_counts(texts: DataFrame, text_col: str, n_max: int, n_buckets: int) -> np.ndarray:
    """Features of all texts by bucket; counted within each task first."""

    def run(batches):
        counts = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for block in T.blocks(batch.column(0), lower=True):
                for bucket, _ in buckets_of(block, n_max, n_buckets)[1]:
                    counts += np.bincount(bucket, minlength=n_buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    summed = texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_buckets, dtype=np.int64)
    counts[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return counts


def bucket_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares), per bucket."""
    t, s, n = target.astype(float), source.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, n_max: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_words, n_features, weight of every document."""
    src = docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key"))

    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column(1), lower=True):
                words, found = buckets_of(block, n_max, len(gains))
                count, total = np.zeros(len(block), dtype=np.int64), np.zeros(len(block), dtype=np.int64)
                for bucket, doc in found:
                    first = np.searchsorted(doc, np.arange(len(block) + 1))
                    count += np.diff(first)
                    total += T.per_doc(gains[bucket], first)
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                part = slice(block.row, block.row + len(block))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(2)[part], pa.array(np.diff(words.first)), pa.array(count), pa.array(weight)],
                    names=[id_col, "text_key", "n_words", "n_features", "weight"],
                )

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text_key long, n_words long, n_features long, weight long")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, n_max: int = 2, n_buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Every document's id, n_words, n_features, weight, score, and its rank if it is among the drawn.

    Drawn are floor(percent * N / 100) of the N documents with ``min_words`` words or more.  ``scratch``: where the
    scored rows are written; pass one to drop it after use.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "resample")
    gains = bucket_gains(bucket_counts(target, target_col, n_max, n_buckets), bucket_counts(docs, text_col, n_max, n_buckets))
    uniform = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    scored = scratch.write("scored", weigh(docs, gains, n_max, id_col, text_col).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))))

    table = scored.where(F.col("n_words") >= min_words).groupBy("score").agg(F.count("*").alias("n")).toArrow()
    score, n = table["score"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(-score)
    score, n = score[order], n[order]
    above = np.cumsum(n) - n
    draw = percent * int(n.sum()) // 100
    held = above < draw
    columns = [id_col, "n_words", "n_features", "weight", "score"]
    if not held.any():
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    cut = int(score[held][-1])
    ahead = spark.createDataFrame(pa.table({"score": score[held], "above": above[held]}))
    near = F.col("score") >= cut
    within = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "text_key")
    top = scored.where(near & (F.col("n_words") >= min_words)).join(F.broadcast(ahead), "score")  # as many rows as scores
    ranked = top.withColumn("rank", F.col("above") + F.row_number().over(within)).select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~(near & (F.col("n_words") >= min_words))).select(*columns, F.lit(None).cast("long").alias("rank")))
