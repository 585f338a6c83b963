"""Removal of lines that many documents share: counts of key hashes, a Bloom filter of the frequent ones, an exact confirmation.

A line's key is the line without white space at both ends, A-Z lower-cased.  One pass over the texts gives a 64-bit
hash of each key of a block and the number of its documents; their sums by hash are a plain aggregate.  Hashes of
enough documents go into a Bloom filter, so no key of enough documents is missing there.  In a second pass only
suspects, keys in the filter, leave their block: one row per block and key with the number of its documents, and a
cryptographic digest of the key, by which counts are added up exactly.  Keys of too few documents end there.

The removal pass reads a table of the confirmed keys: broadcast up to ``broadcast_keys`` (24 bytes each); beyond
that suspects' places are joined to it by shuffle, salted against lines that stand everywhere, and each document
gets the numbers of its lines to drop.

Bounds: at most one row of two numbers is shuffled for each line.  The filter is sized by the planner's size of the
table between 2**20 and 2**``most_bits`` bits (64 MB by default) and is broadcast; with more frequent keys than it has
room for, more keys are suspected and shuffled, with the same result.  Tasks hold a block's lines.  64-bit hashes only
pick and group keys.

Cases: a null or empty text is one empty line; keys under ``min_chars`` code points are never dropped.  Rows count as
documents, repeated ones each.  With ``keep_first`` the first line of the document of the smallest id stays (nulls last;
rows of equal id and text each keep it; ties by a hash of the text).  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch, planned_bytes

_U = np.uint64
_PROBES = 3


class Lines:
    """The lines of a block: byte spans of lines and of keys, the text and number of each, a hash of each key."""

    def __init__(self, block: T.Block, min_chars: int):
        data, n = block.data, len(block)
        breaks = np.flatnonzero(data == 0x0A)
        self.start = np.sort(np.concatenate([block.offset[:-1], breaks + 1]))
        self.end = np.sort(np.concatenate([breaks, block.offset[1:]]))
        self.count = np.diff(np.searchsorted(breaks, block.offset)) + 1
        self.doc = np.repeat(np.arange(n), self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        solid = np.flatnonzero(T.SPACED[data])
        low, high = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        filled = high > low
        padded = np.append(solid, 0)
        self.key_start = np.where(filled, padded[low], 0)
        self.key_end = np.where(filled, padded[high - 1] + 1, 0)
        leads = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
        self.long = np.flatnonzero(leads[self.key_end] - leads[self.key_start] >= min_chars)  # lines that may be dropped
        self.lowered = T.Block(0, T.ASCII_LOWER[data], block.offset)
        self.hash = self.lowered.hashes(self.key_start[self.long], self.key_end[self.long])

    def digest(self, line: int) -> bytes:
        return hashlib.sha256(self.lowered.data[self.key_start[line] : self.key_end[line]].tobytes()).digest()[:16]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each key's hash, a line that has it, and the number of its texts in the block."""
        order = np.argsort(self.hash, kind="stable")
        hashes, doc = self.hash[order], self.doc[self.long[order]]
        new = np.ones(len(order), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(new)
        return hashes[at], self.long[order[at]], np.add.reduceat(other.astype(np.int64), at) if len(at) else np.zeros(0, dtype=np.int64)


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The filter's positions of each hash, a row per probe."""
    step = (hashes >> _U(32)) | _U(1)
    with np.errstate(over="ignore"):
        return np.stack([(hashes + _U(k) * step) & _U(bits - 1) for k in range(_PROBES)])


def twice_seen(docs: DataFrame, bits: int, min_chars: int, text_col: str, min_docs: int = 2) -> np.ndarray:
    """The filter of keys of two documents (``min_docs``) or more, as bytes of eight bits: none of them is missing."""

    def counts(batches):
        for batch in batches:
            for block in T.blocks(batch.column(0)):
                keys, _, texts = Lines(block, min_chars).distinct()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(texts)], names=["hash", "n"])

    def places(batches):
        for batch in batches:
            place = _bits(batch.column(0).to_numpy().view(np.uint64), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((place >> _U(6)).astype(np.int64)), pa.array((_U(1) << (place & _U(63))).view(np.int64))], names=["word", "mask"])

    often = docs.select(text_col).mapInArrow(counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    found = often.select("hash").mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype="<u8")
    out[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _suspected(hashes: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    seen = np.ones(len(hashes), dtype=bool)
    for position in _bits(hashes, 8 * len(bloom)):
        seen &= bloom[position >> _U(3)] >> (position & _U(7)).astype(np.uint8) & 1 > 0
    return seen


def common_lines(docs: DataFrame, filter_bytes, min_docs: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """hash, digest, first (id, text_key, line) of each key that so many documents have.  filter_bytes: a broadcast of ``twice_seen``."""
    src = docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key"))
    kind = src.schema[id_col].dataType.simpleString()

    def suspects(batches):
        bloom = np.frombuffer(filter_bytes.value, dtype=np.uint8)
        for batch in batches:
            rank = np.empty(len(batch), dtype=np.int64)  # the smallest id of the block goes along as the first
            rank[pa.Table.from_batches([batch.select([0, 2])]).append_column("row", pa.array(np.arange(len(batch)))).sort_by([(batch.schema.names[0], "ascending"), ("text_key", "ascending")])["row"].to_numpy()] = np.arange(len(batch))
            for block in T.blocks(batch.column(1)):
                lines = Lines(block, min_chars)
                keys, line, texts = lines.distinct()
                at = np.flatnonzero(_suspected(keys, bloom))
                if not len(at):
                    continue
                mine = np.flatnonzero(np.isin(lines.hash, keys[at]))
                order = mine[np.lexsort((lines.long[mine], rank[block.row + lines.doc[lines.long[mine]]], lines.hash[mine]))]
                _, head = np.unique(lines.hash[order], return_index=True)
                first = lines.long[order[head]]  # in the order of the hashes, as keys[at]
                row = pa.array(block.row + lines.doc[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at].view(np.int64)), pa.array([lines.digest(k) for k in line[at]], pa.binary()), pa.array(texts[at]), batch.column(0).take(row), batch.column(2).take(row), pa.array(first - lines.first[lines.doc[first]])],
                    names=["hash", "digest", "n", "id", "text_key", "line"],
                )

    found = src.mapInArrow(suspects, f"hash long, digest binary, n long, id {kind}, text_key long, line long")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "text_key", "line")).alias("first")
    return found.groupBy("hash", "digest").agg(F.sum("n").alias("n_docs"), first).where(F.col("n_docs") >= min_docs)


def _removed(block: T.Block, lines: Lines, drop: np.ndarray) -> pa.Array:
    """The block's texts without the lines marked."""
    hit = np.flatnonzero(np.add.reduceat(drop, lines.first[:-1])) if len(block) else []
    raw, out, at = block.data.tobytes(), [], 0
    spans = list(zip(lines.start.tolist(), lines.end.tolist(), strict=True)) if len(hit) else []
    size = np.diff(block.offset)
    for d in hit:
        out.append(raw[block.offset[at] : block.offset[d]])
        a, b = lines.first[d], lines.first[d + 1]
        kept = b"\n".join(raw[s:e] for (s, e), gone in zip(spans[a:b], drop[a:b].tolist(), strict=True) if not gone)
        out.append(kept)
        size[d], at = len(kept), d + 1
    out.append(raw[block.offset[at] :])
    return T.strings(np.frombuffer(b"".join(out), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)]))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 29, broadcast_keys: int = 500_000, scratch: Scratch | None = None) -> DataFrame:
    """id, n_lines (before), n_dropped, kept (the text without lines whose key ``min_docs`` documents have)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    size = planned_bytes(docs.select(text_col))
    bits = 1 << (most_bits if size is None else min(max(20, (4 * size).bit_length()), most_bits))
    bloom = spark.sparkContext.broadcast(twice_seen(docs, bits, min_chars, text_col, min_docs).tobytes())
    common = scratch.write("common", common_lines(docs, bloom, min_docs, min_chars, id_col, text_col))
    src = docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key"))
    kind = src.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_lines long, n_dropped long, kept string"

    def result(batch, block, lines, drop):
        part = slice(block.row, block.row + len(block))
        dropped = np.add.reduceat(drop.astype(np.int64), lines.first[:-1])
        return pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(lines.count), pa.array(dropped), _removed(block, lines, drop)], names=[id_col, "n_lines", "n_dropped", "kept"])

    if common.count() <= broadcast_keys:
        table = common.select("hash", "digest", "first.id", "first.text_key", "first.line").toArrow()
        order = np.argsort(table["hash"].to_numpy().view(np.uint64))
        known = table["hash"].to_numpy().view(np.uint64)[order]
        sent = spark.sparkContext.broadcast((known, *(table[c].take(pa.array(order)).to_pylist() for c in ("digest", "id", "text_key", "line"))))

        def remove(batches):
            known, digests, ids, text_keys, places = sent.value
            for batch in batches:
                for block in T.blocks(batch.column(1)):
                    lines = Lines(block, min_chars)
                    drop = np.zeros(len(lines.start), dtype=bool)
                    near = lines.long[np.isin(lines.hash, known)]
                    keys, one, which = np.unique(lines.hash[np.isin(lines.hash, known)], return_index=True, return_inverse=True)
                    entry = np.full(len(keys), -1)
                    for k, at in enumerate(np.searchsorted(known, keys).tolist()):
                        digest = lines.digest(near[one[k]])
                        while at < len(known) and known[at] == keys[k]:
                            if digests[at] == digest:
                                entry[k] = at
                            at += 1
                    drop[near] = entry[which] >= 0
                    if keep_first:
                        for line, at in zip(near.tolist(), entry[which].tolist(), strict=True):
                            row = block.row + int(lines.doc[line])
                            if at >= 0 and places[at] == line - lines.first[lines.doc[line]] and text_keys[at] == batch.column(2)[row].as_py() and ids[at] == batch.column(0)[row].as_py():
                                drop[line] = False
                    yield result(batch, block, lines, drop)

        return src.mapInArrow(remove, schema)

    def places(batches):
        seen = np.frombuffer(bloom.value, dtype=np.uint8)
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                lines = Lines(block, min_chars)
                at = np.flatnonzero(_suspected(lines.hash, seen))
                line = lines.long[at]
                row, told = pa.array(block.row + lines.doc[line]), {}
                for h, k in zip(lines.hash[at].tolist(), line.tolist(), strict=True):
                    if h not in told:
                        told[h] = lines.digest(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([told[h] for h in lines.hash[at].tolist()], pa.binary()), batch.column(0).take(row), batch.column(2).take(row), pa.array(line - lines.first[lines.doc[line]])],
                    names=["digest", "id", "text_key", "line"],
                )

    salts = 32
    suspects = src.mapInArrow(places, f"digest binary, id {kind}, text_key long, line long").distinct().withColumn("salt", F.pmod(F.xxhash64("id", "text_key"), F.lit(salts)))
    each = common.select("digest", F.col("first.id").alias("first_id"), F.col("first.text_key").alias("first_key"), F.col("first.line").alias("first_line"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    gone = suspects.join(each, ["digest", "salt"])
    if keep_first:
        gone = gone.where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")) & (F.col("line") == F.col("first_line"))))
    drops = scratch.write("drops", gone.groupBy("id", "text_key").agg(F.collect_list("line").alias("lines")))
    whole = src.withColumnRenamed(id_col, "own_id").join(drops.select(F.col("id").alias("drop_id"), F.col("text_key").alias("drop_key"), "lines"), F.col("own_id").eqNullSafe(F.col("drop_id")) & (F.col("text_key") == F.col("drop_key")), "left")

    def apply(batches):
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                lines = Lines(block, min_chars)
                drop = np.zeros(len(lines.start), dtype=bool)
                for d, gone in enumerate(batch.column(2)[block.row : block.row + len(block)].to_pylist()):
                    if gone:
                        drop[lines.first[d] + np.array(gone)] = True
                yield result(batch, block, lines, drop)

    return whole.select(F.col("own_id").alias(id_col), text_col, "lines").mapInArrow(apply, schema)
