"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of ``size`` consecutive words (an item of fewer words is one
window).  A window is the set of its shingles with their places; a document contains it exactly if it has
all of them, so with the shingles ordered by rarity a prefix of one, the rarest, must be met: only
positions of documents that hold some window's rarest shingle become candidates.  The length bound (the
window fits into the text) and the positional bound (it starts where the shingle's place says) follow, and
an item-sized slice of the document is then compared word for word.

Rarity is counted over all documents.  The window table is broadcast only if it is within ``small`` rows,
else both joins shuffle by shingle hash and carry just the words around each position.

Words: A-Z lower-cased, runs of ASCII digits, a-z and characters beyond ASCII.
Cases: null and empty texts have no words and are clean; items without words match nothing; repeated
rows of documents each get their row; repeated benchmark rows count once per item_id, a null item_id
counts in n_hit but not among the items; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native as N
from .scratch import Scratch


def _windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    items = benchmark.select(F.col(id_col).alias("item_id"), N.words(F.col(text_col)).alias("w")).withColumn("n", N.n_words(F.col("w")).cast("int")).where("n > 0")
    placed = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)))))
    return placed.select("item_id", F.expr(f"slice(w, at + 2, least(n, {size}))").alias("words")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, shingle: int = 5, small: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    scratch = Scratch(docs.sparkSession, "decontam")
    owned = scratch.write("windows", _windows(benchmark, size, item_id, item_text).withColumn("window", F.xxhash64("words")))
    windows = owned.groupBy("window", "words").agg(F.lit(1)).select("window", "words", F.size("words").alias("n"))
    placed = windows.withColumn("k", F.least("n", F.lit(shingle))).withColumn("place", F.explode(F.expr("sequence(0, n - k)")))
    lengths = sorted(r.k for r in placed.select("k").distinct().collect())  # at most ``shingle`` values
    hashed = F.coalesce(*(F.when(F.col("k") == k, N.gram(F.col("words"), F.col("place"), k)) for k in lengths or [shingle]))
    placed = scratch.write("shingles", placed.withColumn("h", hashed))
    narrow = placed.limit(small + 1).count() <= small
    mark = F.broadcast if narrow else lambda df: df

    at = N.positions(docs, id_col, text_col)
    grams = [F.when(F.col("pos") > 0, N.gram(F.col("w"), F.col("pos"), k)).otherwise(F.lit(N.HEAD) if i == 0 else None) for i, k in enumerate(lengths or [shingle])]
    if len(grams) == 1:
        at = at.withColumn("h", grams[0])
    else:
        at = at.withColumn("h", F.explode(F.array(*grams)))
    if narrow:
        near, shift = F.col("w"), F.lit(0)
    else:  # a shuffled row carries the words that a window over this position may hold, not the text
        near, shift = F.expr(f"slice(w, greatest(pos - {size} + 2, 1), 2 * {size})"), F.expr(f"greatest(pos - {size} + 1, 0)")

    counts = at.select("h").join(mark(placed.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("freq"))
    rarest = placed.join(counts, "h").groupBy("window", "words", "n").agg(F.min(F.struct("freq", "place", "h")).alias("r")).select("r.h", "r.place", "window", "words", "n")
    no_window = [F.lit(0).alias("place"), F.lit(None).cast("long").alias("window"), F.lit(None).cast("array<string>").alias("words"), F.lit(0).alias("n")]
    columns = [F.col(c) for c in ("doc_id", "text_key", "n_words", "pos", "h")] + [near.alias("near"), shift.cast("int").alias("shift")]
    if narrow:  # each text's first row finds a row of its own in the broadcast table
        prefix = scratch.write("prefix", rarest.unionByName(docs.sparkSession.range(1).select(F.lit(N.HEAD).alias("h"), *no_window)))
        joined = at.select(*columns).join(F.broadcast(prefix), "h")
    else:  # these rows, one a text, stay out of the shuffle by hash: they would all have one key
        prefix = scratch.write("prefix", rarest)
        heads = at.where("pos = 0").select(*(F.col(c) for c in ("h", "doc_id", "text_key", "n_words", "pos")), F.lit(None).cast("array<string>").alias("near"), F.lit(0).alias("shift"), *no_window)
        heads = heads.where(F.col("h") == N.HEAD)
        joined = at.where("pos > 0").select(*columns).join(prefix, "h").unionByName(heads)
    start = F.col("pos") - F.col("place")
    met = joined.withColumn("start", start).where("window is null or (start >= 1 and start + n - 1 <= n_words and slice(near, start - shift + 1, n) = words)")
    span = F.when(F.col("window").isNotNull(), F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e")))
    hits = scratch.write("hits", met.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.sum(F.when(F.col("window").isNull(), 1).otherwise(0)).alias("copies"), F.collect_set(span).alias("spans"), F.collect_set("window").alias("windows")))

    # the HEAD row of each copy is one match, so copies counts rows; spans of equal rows coincide
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("c")), lambda a, x: F.struct(F.greatest(a["e"], x["e"]).alias("e"), (a["c"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"])).cast("long")).alias("c")))["c"]
    found = hits.select("doc_id", "text_key", F.explode("windows").alias("window")).join(owned.select("window", "item_id").where("item_id is not null").distinct(), "window").groupBy("doc_id", "text_key").agg(F.collect_set("item_id").alias("items"))
    same = F.expr("h.doc_id <=> f.doc_id and h.text_key <=> f.text_key")
    every = hits.alias("h").join(found.alias("f"), same, "left").select("h.doc_id", "h.text_key", "h.n_words", "h.copies", covered.alias("n_hit"), F.coalesce("f.items", F.array().cast(found.schema["items"].dataType)).alias("items"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    out = every.select("doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "copies")
    return N.each_copy(out, "copies")
