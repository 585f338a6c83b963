"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles.  Texts with equal sets form one class and are compared once.  Candidates are
pairs that share a MinHash band's bucket.  Members of a bucket are first compared with its smallest member
(a star, so a bucket of any size adds one row per member); where all of them may reach the threshold with it,
they are together already.  In the other buckets the remaining pairs are compared with each other, in pairs of
blocks of members that are units of work of their own; the first bucket that a pair shares owns it.  A
comparison takes MinHash values a slice at a time and drops the pair once the posterior probability that its
similarity reaches the threshold is below ``tolerance``.  What survives is linked to groups by connected
components, so texts that only share boilerplate don't meet in one group.  A group is cut into blocks again,
and each pair of blocks is pruned in the same way and verified exactly by intersecting the shingle sets.
Units return link counts and a spanning star per text, never the pairs, so nothing but the comparisons
themselves grows with the square of a bucket or group.

At 32 bands of 4 values a pair at similarity 0.8 is missed with probability (1 - 0.8**4)**32 < 5e-8, and
pruning loses one with probability near ``tolerance``.

Words are runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII.  A text of fewer
words than a shingle is one shingle of all its words.  Cases: null texts and texts without words have no
shingles and link to nothing, each its own class; repeated rows (also of one doc_id) each get their row
and count as copies; an empty table gives no rows; a null doc_id is a text like others, named null.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import connected_components
from .scratch import Scratch, broadcast_if_small

_U = np.uint64


def shingles(block: T.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of a block, ordered by text, and the offsets of each text's keys."""
    words = block.words(T.ALNUM)
    hashes = block.hashes(words.start, words.end)
    grams, at = T.ngrams(hashes, words.doc, n)
    doc = words.doc[at]
    short = np.flatnonzero((np.diff(words.first) < n) & (np.diff(words.first) > 0))
    if len(short):
        whole = block.hashes(words.start[words.first[short]], words.end[words.first[short + 1] - 1])
        for i, t in enumerate(short):  # separators don't count: hash the words one after the other
            x = _U(0)
            for h in hashes[words.first[t] : words.first[t + 1]]:
                x = T.mix(np.array([x ^ h], dtype=np.uint64))[0]
            whole[i] = x
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
    # 48 bits of hash under 16 bits of text index: one sort orders and removes repeats
    keys = np.unique((doc.astype(np.uint64) << _U(48)) | (grams >> _U(16)))
    return keys & _U((1 << 48) - 1), np.searchsorted(keys, np.arange(len(block) + 1, dtype=np.uint64) << _U(48)) if len(block) < 0xFFFF else np.searchsorted(keys >> _U(48), np.arange(len(block) + 1, dtype=np.uint64))


def minhash(keys: np.ndarray, first: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """(texts, count) smallest values under ``count`` hash functions; rows without keys are all ones."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 31, count, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    b = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)
    out = np.full((len(first) - 1, count), 0xFFFFFFFF, dtype=np.uint32)
    filled = np.flatnonzero(np.diff(first))
    if not len(filled):
        return out
    mixed = T.mix(keys)
    low, high = mixed.astype(np.uint32), (mixed >> _U(32)).astype(np.uint32)
    starts = first[filled]
    with np.errstate(over="ignore"):
        for k in range(count):
            x = low * a[k]
            x ^= x >> np.uint32(15)
            x += high * b[k] | np.uint32(1)
            x *= np.uint32(0x85EBCA6B)
            out[filled, k] = np.minimum.reduceat(x, starts)
    return out


def least_matches(threshold: float, tolerance: float, steps: list[int]) -> list[int]:
    """Per number of compared values, the fewest matches at which P(similarity >= threshold) >= tolerance (uniform prior)."""
    out = []
    for n in steps:
        for m in range(n + 1):
            tail = sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
            if tail >= tolerance:  # = 1 - I_threshold(m + 1, n - m + 1)
                out.append(m)
                break
    return out


def _spanning(i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row the least name that links among the rows reach."""
    label = names.copy()
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            break
        label = new
    return label


def _survivors(left: np.ndarray, right: np.ndarray, least: list[tuple[int, int]], wanted, rows: int = 64):
    """Pairs of rows of two blocks of MinHash bytes that are never dropped; ``wanted`` masks the pairs of some left rows."""
    found = []
    upto, fewest = least[0]
    for k in range(0, len(left), rows):
        part = left[k : k + rows]
        matches = (part[:, None, :upto] == right[None, :, :upto]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero((matches >= fewest) & wanted(k, k + len(part)))
        matches, done = matches[i, j], upto
        for more, enough in least[1:]:
            matches = matches + (part[i, done:more] == right[j, done:more]).sum(axis=1, dtype=np.int32)
            keep, done = matches >= enough, more
            i, j, matches = i[keep], j[keep], matches[keep]
        found.append((i + k, j))
    return (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bytes_of(column: pa.Array, values: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, values)


def _likely(values: int, least: list[tuple[int, int]]):
    """Stars to (rep, head, likely)."""

    def run(batches):
        for batch in batches:
            same = _bytes_of(batch.column("sig_a"), values) == _bytes_of(batch.column("sig_b"), values)
            ok = np.ones(len(batch), dtype=bool)
            for upto, fewest in least:
                ok &= same[:, :upto].sum(axis=1) >= fewest
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("head"), pa.array(ok)], names=["rep", "head", "likely"])

    return run


def _compare(values: int, least: list[tuple[int, int]]):
    """Sorted rows (bucket, i, j, at, rep, near, sig8) of units to spanning stars (a, b) of the pairs that survive.

    A pair that shares several buckets survives in each; a row has one edge a unit at most, so that adds no pairs.
    """

    def unit(table: pa.Table):
        own = table["i"][0].as_py()
        at, rep, near = (table[c].to_numpy() for c in ("at", "rep", "near"))
        sig = _bytes_of(table["sig8"].combine_chunks(), values)
        same = own == table["j"][0].as_py()
        left = np.flatnonzero(at == own)
        right = left if same else np.flatnonzero(at != own)
        if not len(left) or not len(right):
            return
        later = np.arange(len(left))

        def wanted(a, b):  # pairs that both are near the head are together already
            pairs = ~(near[left[a:b], None] & near[right][None, :])
            return pairs & (later[a:b, None] < later[None, :]) if same else pairs

        i, j = _survivors(sig[left], sig[right], least, wanted)
        i, j = left[i], right[j]
        label = _spanning(i, j, rep)
        moved = np.flatnonzero(label != rep)
        yield from zip(rep[moved].tolist(), label[moved].tolist(), strict=True)

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 2)], names=["a", "b"])

    def run(batches):
        out, held = [], None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([held[c].to_numpy() for c in ("bucket", "i", "j")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [held.num_rows]])
            for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                out.extend(unit(held.slice(a, b - a)))
            held = held.slice(cuts[-2])
            if len(out) > 20_000:
                yield emit(out)
                out = []
        if held is not None and held.num_rows:
            out.extend(unit(held))
        yield emit(out)

    return run


def _sketch(n: int, count: int, bands: int):
    rows_per_band = count // bands

    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column(1), lower=True):
                keys, first = shingles(block, n)
                size = np.diff(first)
                sums = np.zeros((2, len(keys) + 1), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(2):
                        np.cumsum(T.mix(keys + _U(k + 1) * _U(0x9E3779B97F4A7C15)), out=sums[k, 1:])
                    whole = sums[:, first[1:]] - sums[:, first[:-1]]
                    sig = minhash(keys, first, count)
                    band = np.zeros((len(block), bands), dtype=np.uint64)
                    for k in range(rows_per_band):
                        band = T.mix(band + sig[:, k::rows_per_band].astype(np.uint64) + _U(k + 1))
                    band += np.arange(bands, dtype=np.uint64)
                    band = T.mix(band)
                bands_col = pa.ListArray.from_arrays(np.arange(len(block) + 1, dtype=np.int32) * bands, pa.array(band.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.row, len(block)), batch.column(2).slice(block.row, len(block)), pa.array(size), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary()), bands_col],
                    names=["doc_id", "row_key", "n_shingles", "set_a", "set_b", "sig", "sig8", "bands"],
                )

    return run


def _shingle_rows(n: int):
    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column(1), lower=True):
                keys, first = shingles(block, n)
                raw = [keys[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row, len(block)), pa.array(raw, pa.binary())], names=["row_key", "keys"])

    return run


def _verify_unit(left: list[dict], right: list[dict], same: bool, threshold: float, least: list[tuple[int, int]]):
    """Links between two blocks of a group: per text the linked texts and documents, and star edges."""
    sig = [np.stack([np.frombuffer(r["sig"], dtype=np.uint32) for r in side]) for side in (left, right)]
    i, j = np.triu_indices(len(left), 1) if same else (x.reshape(-1) for x in np.indices((len(left), len(right))))
    matches, done = np.zeros(len(i), dtype=np.int32), 0
    for upto, fewest in least:
        if not len(i):
            break
        for k in range(0, len(i), 1 << 15):
            part = slice(k, k + (1 << 15))
            matches[part] += (sig[0][i[part], done:upto] == sig[1][j[part], done:upto]).sum(axis=1, dtype=np.int32)
        keep, done = matches >= fewest, upto
        i, j, matches = i[keep], j[keep], matches[keep]
    links = np.zeros(len(i), dtype=bool)
    if len(i):
        sides = [np.unique(i), np.unique(j)]
        raw = [[np.frombuffer(rows[x]["keys"], dtype=np.uint64) for x in at] for rows, at in zip((left, right), sides, strict=True)]
        sizes = [np.array([len(x) for x in r]) for r in raw]
        at = np.searchsorted(sides[0], i), np.searchsorted(sides[1], j)
        if len(i) <= 4 * (len(sides[0]) + len(sides[1])):
            shared = np.array([len(np.intersect1d(raw[0][x], raw[1][y], assume_unique=True)) for x, y in zip(*at, strict=True)])
        else:
            shared = _intersections(raw[0], raw[1])[at]
        # shared / union >= threshold, in whole numbers of shingles
        links = shared * (1 + threshold) + 1e-9 >= threshold * (sizes[0][at[0]] + sizes[1][at[1]])
    i, j = i[links], j[links]
    return i, j


def _intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of 0/1 matrices over slices of the shared keys."""
    flat = [np.concatenate(x) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right)]
    common = np.intersect1d(flat[0], flat[1])
    col = [np.searchsorted(common, x) for x in flat]
    hit = [(c < len(common)) & (common[np.minimum(c, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool) for c, x in zip(col, flat, strict=True)]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for k in range(0, len(common), columns):
        dense = []
        for r, c, h, n in zip(row, col, hit, (len(left), len(right)), strict=True):
            m = np.zeros((n, columns), dtype=np.float32)
            pick = h & (c >= k) & (c < k + columns)
            m[r[pick], c[pick] - k] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _verify(threshold: float, least: list[tuple[int, int]]):
    """Sorted rows of units to one row per text and unit."""

    def unit(rows: list[dict]):
        b, c = rows[0]["i"], rows[0]["j"]
        left = [r for r in rows if r["at"] == b]
        right = left if b == c else [r for r in rows if r["at"] == c]
        if not left or not right:
            return
        i, j = _verify_unit(left, right, b == c, threshold, least)
        both = left if b == c else left + right
        j = j if b == c else j + len(left)
        n = len(both)
        copies = np.array([r["copies"] for r in both], dtype=np.int64)
        texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        docs = (np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)).astype(np.int64)
        names = np.array([r["rep"] for r in both], dtype=np.int64)
        label = _spanning(i, j, names)
        for k in np.flatnonzero(texts):
            yield int(names[k]), int(texts[k]), int(docs[k]), int(label[k])

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["rep", "texts", "docs", "label"])

    def run(batches):
        out, held, key = [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["component"], row["i"], row["j"])
                if now != key:
                    if len(held) > 1:
                        out.extend(unit(held))
                    held, key = [], now
                    if len(out) > 20_000:
                        yield emit(out)
                        out = []
                held.append(row)
        if len(held) > 1:
            out.extend(unit(held))
        yield emit(out)

    return run


def _candidates(reps: DataFrame, scratch: Scratch, values: int, least: list[tuple[int, int]], members: int) -> DataFrame:
    """(a, b): links between sets that may reach the threshold, enough of them to join all such pairs to groups.

    sig8 has the lowest byte of each MinHash value: a 256th of the unequal ones match too, which drops no pair.
    """
    light = reps.select("rep", "sig8", "bands")
    banded = light.select("rep", F.explode("bands").alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.write("shared", banded.join(heads, "bucket"))
    sig = lambda rep, name: light.select(F.col("rep").alias(rep), F.col("sig8").alias(name))
    pairs = shared.where("rep <> head").select("rep", "head").distinct().join(sig("rep", "sig_a"), "rep").join(sig("head", "sig_b"), "head")
    stars = scratch.write("stars", pairs.mapInArrow(_likely(values, least), "rep long, head long, likely boolean"))
    flagged = shared.join(stars, ["rep", "head"], "left").withColumn("near", F.coalesce("likely", F.lit(True)))  # the head is near itself
    mixed = flagged.where("not near").select("bucket").distinct()
    blocks = F.ceil(F.col("n") / members).cast("int")
    placed = flagged.join(mixed, "bucket", "left_semi").select("bucket", "rep", "near", blocks.alias("nb"), F.pmod(F.xxhash64("rep", F.lit(1)), blocks.cast("long")).cast("int").alias("at")).join(light.select("rep", "sig8"), "rep")
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "rep", "near", "sig8")
    found = units.repartition(F.col("bucket"), F.col("i"), F.col("j")).sortWithinPartitions("bucket", "i", "j").mapInArrow(_compare(values, least), "a long, b long").distinct()
    return stars.where("likely").select(F.col("rep").alias("a"), F.col("head").alias("b")).unionAll(found)


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, values: int = 128, bands: int = 32, tolerance: float = 1e-7, block: int = 512, members: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (smallest doc_id of the linked class), copy_id (of equal shingle sets), n_links, n_text_links, n_copies, is_first.

    n_links counts the other documents at or above the threshold, n_text_links the other shingle sets.
    is_first is true for one row of each class.  ``block`` is the number of texts a side of one unit of verification, ``members`` that of candidate search.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("row_key"))
    sketch = scratch.write("sketch", rows.mapInArrow(_sketch(n, values, bands), "doc_id long, row_key long, n_shingles long, set_a long, set_b long, sig binary, sig8 binary, bands array<long>"))
    sets = scratch.write("sets", sketch.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("row_key").alias("rep"), F.min("doc_id").alias("copy_id"), F.count("*").alias("copies")))
    # one row of each set: its representative; rows repeated whole share the key and all values
    reps = sketch.join(sets.where("copies > 0").select("rep", "copies", F.col("set_a").alias("sa"), F.col("set_b").alias("sb")), (F.col("row_key") == F.col("rep")) & (F.col("set_a") == F.col("sa")) & (F.col("set_b") == F.col("sb"))).select("rep", "copies", "sig", "sig8", "bands")
    reps = scratch.write("reps", reps.groupBy("rep").agg(F.first("copies").alias("copies"), F.first("sig").alias("sig"), F.first("sig8").alias("sig8"), F.first("bands").alias("bands")))
    keyed_rows = scratch.write("keyed", sketch.select("doc_id", "row_key", "n_shingles", "set_a", "set_b"))
    scratch.drop("sketch")  # all that follows reads the tables made of it
    steps = [k for k in (16, 32, 64, 96, values) if k <= values]
    least = list(zip(steps, least_matches(threshold, tolerance, steps), strict=True))
    groups = scratch.write("groups", connected_components(_candidates(reps, scratch, values, least, members), scratch, "candidates"))
    for used in ("shared", "stars"):
        scratch.drop(used)
    sizes = groups.groupBy("component").agg(F.count("*").alias("m")).withColumn("nb", F.ceil(F.col("m") / block).cast("int"))
    member = scratch.write("member", groups.join(sizes, "component").select(F.col("node").alias("rep"), "component", "nb", F.pmod(F.xxhash64("node"), F.col("nb").cast("long")).cast("int").alias("at")))
    texts = rows.join(broadcast_if_small(member.select(F.col("rep").alias("row_key")), 2_000_000), "row_key", "left_semi").dropDuplicates(["row_key"]).select("row_key", "text")
    keyed = texts.mapInArrow(_shingle_rows(n), "row_key long, keys binary").withColumnRenamed("row_key", "rep")
    full = scratch.write("full", member.join(reps.select("rep", "copies", "sig"), "rep").join(keyed, "rep"))
    units = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("component", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "rep", "copies", "sig", "keys")
    dealt = units.repartition(F.col("component"), F.col("i"), F.col("j")).sortWithinPartitions("component", "i", "j")
    linked = scratch.write("linked", dealt.mapInArrow(_verify(threshold, least), "rep long, texts long, docs long, label long"))
    classes = connected_components(linked.select(F.col("rep").alias("a"), F.col("label").alias("b")), scratch, "classes")
    for used in ("reps", "groups", "member", "full"):
        scratch.drop(used)
    counts = linked.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    of_set = sets.join(counts, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least_id = of_set.groupBy("component").agg(F.min("copy_id").alias("class_id"), F.min("rep").alias("first_rep"))
    of_set = of_set.join(least_id, "component").select("set_a", "set_b", "rep", "copy_id", "copies", "class_id", "first_rep", F.coalesce("texts", F.lit(0)).alias("n_text_links"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    wordless = keyed_rows.where("n_shingles = 0").select("doc_id", "row_key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("is_first"))
    worded = keyed_rows.where("n_shingles > 0").join(of_set, ["set_a", "set_b"]).select("doc_id", "row_key", "class_id", "copy_id", "n_links", "n_text_links", F.col("copies").alias("n_copies"), (F.col("row_key") == F.col("first_rep")).alias("is_first"))
    return worded.unionAll(wordless)
