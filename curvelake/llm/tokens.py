"""Token ids in binary shards: independent zstandard frames, a trailing seek table, per-frame checksums.

A shard is a valid zstandard stream::

    frame of document 0 | frame of document 1 | ... | index | seek table

Each frame holds one document's ids (little-endian, 2 or 4 bytes each) and its own content checksum.
``index`` is a skippable frame with a header (id width, shard number, documents, ids) and one
(doc_id, has_id, n_ids) entry per document.  ``seek table`` is the skippable frame of the seekable
format: compressed size, size and XXH64's lower half for each frame, then the footer, which ends the
file.  Shards go out through Spark's text writer, so they reach any store Spark reaches and a lost task
leaves no half file; the separator that it puts after a row is set to the footer's magic number.  A
reader decompresses only the frames of the documents it is asked for.

Cases: null counts as the empty text and gets just the end id; repeated rows each get a frame, null ids
come first and ties in the id are ordered by text hash; an empty table has no shards and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .scratch import Scratch, broadcast_if_small, planned_bytes

_SKIP, _SEEK, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: The footer's last four bytes; the text writer puts them there as its line separator.
_MAGIC = struct.pack("<I", _SEEKABLE)
_HEAD = struct.Struct("<4sIqqq")
_ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n_ids", "<i8")])
_FRAME = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])

#: Chunks of more characters than this aren't kept between blocks.
_LONG = 64


class ChunkEncoder:
    """Encodes text chunk by chunk with one dictionary look-up for each chunk seen before.

    Byte-level BPE of this kind never merges over a single space between two non-space characters, so
    the text's ids are those of its pieces cut before such spaces.  New pieces go through the tokenizers
    library.  The dictionary is emptied at ``limit`` pieces; that changes no result.
    """

    def __init__(self, path: str, limit: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many of these as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 0x10000 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True  # how byte-level BPE spells a space
        self.limit, self.known = limit, {}
        self.cut = re.compile(r"(?<=\S) (?=\S)").split

    def _learn_odd(self, pieces: list[str]) -> None:
        got = self.tokenizer.encode_batch_fast([x[1:] if x[0] == " " else " " + x for x in pieces], add_special_tokens=False)
        self.known.update((x, array(self.kind, e.ids).tobytes()) for x, e in zip(pieces, got, strict=True))

    def _learn(self, pieces: list[str], group: int = 64) -> None:
        """Pieces that hold no space, many to a call: only the first id of each one begins with a space."""
        groups = [pieces[k : k + group] for k in range(0, len(pieces), group)]
        got = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, got, strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            raw, width = ids.tobytes(), self.dtype.itemsize
            cut = (np.flatnonzero(self.spaced[ids]) * width).tolist()
            for x, i, j in zip(g, cut, [*cut[1:], len(raw)], strict=True):
                self.known[x] = raw[i:j]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [text.split(" ") for text in texts]
        for cut in parts:
            cut[0] = " " + cut[0]  # no piece begins with a space but the first, which has none before it
        if len(self.known) > self.limit:
            self.known = {}
        fresh = set(chain.from_iterable(parts)).difference(self.known)
        loose = {x for x in fresh if not x or x[-1].isspace() or x.lstrip(" ")[0].isspace()}
        if loose:  # more white space beside a space: cut only where it stands alone; such pieces are never kept
            for i, text in enumerate(texts):
                if not loose.isdisjoint(parts[i]):
                    parts[i] = self.cut(text)
                    parts[i][0] = " " + parts[i][0]
            fresh = set(chain.from_iterable(parts)).difference(self.known)
        odd = {x for x in fresh if " " in x}
        self._learn_odd(list(odd))
        self._learn(list(fresh - odd))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, cut)), dtype=self.dtype) for cut in parts]
        for x in fresh:
            if len(x) > _LONG or x in odd or x in loose:
                del self.known[x]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One a Python worker: the tasks that it runs share what is known."""
    return ChunkEncoder(path)


def pack(shard: int, doc_ids: list[int | None], frames: list[bytes], seek: list[tuple[int, int, int]], counts: list[int], width: int) -> bytes:
    """One shard, but for the magic number at its end."""
    entries = np.zeros(len(doc_ids), dtype=_ENTRY)
    entries["doc_id"] = [x or 0 for x in doc_ids]
    entries["has_id"] = [x is not None for x in doc_ids]
    entries["n_ids"] = counts
    index = _HEAD.pack(b"TOKS", width, shard, len(doc_ids), sum(counts)) + entries.tobytes()
    table = np.array(seek, dtype=_FRAME).tobytes() + struct.pack("<IB", len(seek), 0x80)
    return b"".join([*frames, struct.pack("<II", _SKIP + 1, len(index)), index, struct.pack("<II", _SEEK, len(table) + len(_MAGIC)), table])


class Shard:
    """Reads a shard from its bytes; documents are decompressed one by one, on request."""

    def __init__(self, data):
        self.data = memoryview(data)
        end = len(self.data)
        n, flags, magic = struct.unpack("<IBI", self.data[end - 9 : end])
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table")
        self.frames = np.frombuffer(self.data[end - 9 - n * _FRAME.itemsize : end - 9], dtype=_FRAME)
        self.offset = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        at = int(self.offset[-1]) + 8
        _, self.width, self.number, n_docs, self.n_ids = _HEAD.unpack(self.data[at : at + _HEAD.size])
        self.entries = np.frombuffer(self.data[at + _HEAD.size : at + _HEAD.size + n_docs * _ENTRY.itemsize], dtype=_ENTRY)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.entries)

    def doc_id(self, i: int) -> int | None:
        return int(self.entries["doc_id"][i]) if self.entries["has_id"][i] else None

    def ids(self, i: int) -> np.ndarray:
        raw = self.unpack(self.data[self.offset[i] : self.offset[i + 1]], max_output_size=int(self.frames["size"][i]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames["check"][i]:
            raise ValueError(f"frame {i} of shard {self.number} is damaged")
        return np.frombuffer(raw, dtype=f"<u{self.width}")


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, shard_bytes: int = 16 << 20, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes shards in ascending id order under ``path``; ``shard_bytes`` is the planner's size of input per shard."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = planned_bytes(docs)
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size is None else max(1, -(-size // shard_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def run(batches):
        from pyspark import TaskContext

        T.give_back()  # what earlier stages' tasks left in this worker
        coder = encoder(tokenizer)
        tail = np.array([] if end_id is None else [end_id], dtype=coder.dtype)
        zip_ = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        ids, frames, seek, counts = [], [], [], []
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            for block in T.blocks(texts):
                for tokens in coder.encode(texts.slice(block.row, len(block)).to_pylist()):
                    raw = np.concatenate([tokens, tail]).tobytes()
                    frames.append(zip_(raw))
                    seek.append((len(frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                    counts.append(len(raw) // coder.dtype.itemsize)
            ids += keys
        T.give_back()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pack(TaskContext.get().partitionId(), ids, frames, seek, counts, coder.dtype.itemsize)], pa.binary())], names=["shard"])

    # equal rows may be cut between shards too, so an id of very many rows is no task of its own
    dealt = rows.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(shards, *order, F.col("_nth")).sortWithinPartitions(*order, "_nth").drop("_nth")
    out = dealt.mapInArrow(run, "shard binary").select(F.col("shard").cast("string"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", _MAGIC.decode("iso-8859-1")).text(path)


def read_token_shards(spark: SparkSession, path: str, only: set[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(shard, position, doc_id, start_in_shard, n_tokens, ids_crc32, ids) per document; ``only`` decompresses just these ids' frames.

    Every frame asked for is read and checked; without ``with_ids`` the ids themselves stay behind (null).
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                if not len(raw := data.as_buffer()):
                    continue
                shard = Shard(raw)
                start = np.concatenate([[0], np.cumsum(shard.entries["n_ids"])])
                at = [i for i in range(len(shard)) if only is None or shard.doc_id(i) in only]
                for k in range(0, len(at), 256):
                    part = at[k : k + 256]
                    ids = [shard.ids(i).astype("<u4") for i in part]
                    cols = [[shard.number] * len(part), part, [shard.doc_id(i) for i in part], start[part], shard.entries["n_ids"][part], [zlib.crc32(x.tobytes()) for x in ids]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(ids if with_ids else [None] * len(part), pa.list_(pa.int64()))], names=["shard", "position", "doc_id", "start_in_shard", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "shard long, position long, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long, ids array<long>")


def token_index(docs: DataFrame, tokenizer: str, end_id: int | None = None, path: str | None = None, **options) -> DataFrame:
    """Writes shards (to ``path``, else the shared folder), reads them back: doc_id, start, n_tokens, ids_crc32 in file order."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    path = path or f"{scratch.path}/shards"
    write_token_shards(docs, path, tokenizer, end_id, **options)
    read = scratch.write("read", read_token_shards(spark, path, with_ids=False).drop("ids"))
    return read.join(broadcast_if_small(shard_starts(read), 100_000), "shard").select("doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard", "position")


def shard_starts(read: DataFrame, group: int = 4096) -> DataFrame:
    """(shard, base): the ids in all shards before, by sums within groups of shards and over the groups."""
    totals = read.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("shard") / group))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("n").alias("m")).select("group", F.coalesce(F.sum("m").over(before(Window.orderBy("group"))), F.lit(0)).alias("m"))
    own = totals.select("shard", "group", F.coalesce(F.sum("n").over(before(Window.partitionBy("group").orderBy("shard"))), F.lit(0)).alias("n"))
    return own.join(groups, "group").select("shard", (F.col("n") + F.col("m")).alias("base"))
