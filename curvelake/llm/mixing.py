"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output divided by its share of the input.  Each
document draws a uniform number from a hash of seed and id, inverts the Poisson distribution of its
source's rate at that number, and is repeated so often; then all copies are shuffled globally: each gets a
hash key, the keys deal the copies over partitions and order them there.  The draw depends on nothing but
seed, id and rate, so a lost task redoes the same copies.

Rates come from one row per source (counts are pre-aggregated), broadcast only up to ``small`` sources.
Sources whose mean rate is over half of ``most`` get steps from around the mode (``far_steps``), as many as the
rate asks for, so the draw is the same inversion at any rate.
Cases: null is a source of its own; sources without a target weight get ``default_weight`` (0: none of their rows);
empty texts replicate like others; repeated rows of an id draw the same number and are all repeated; a
null id draws as the text 'null'; without any weight, or with an empty table, there are no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, planned_bytes


def poisson_steps(rate: Column, most: int) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where nothing is left above double precision, ``most`` at the latest."""
    p0 = F.exp(-rate)
    first = F.struct(p0.alias("p"), F.array(p0).alias("c"))

    def step(a, i):
        p = a["p"] * rate / i
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, step)["c"]
    return F.filter(steps, lambda c: c < 1 - 1e-15)


def poisson_inverse(u: Column, steps: Column) -> Column:
    """The smallest k with u <= P(X <= k)."""
    return F.size(F.filter(steps, lambda c: c < u))


def far_steps(rate: float) -> tuple[int, np.ndarray]:
    """first, and P(X <= first), P(X <= first + 1), ...: all but tails below double precision (1e-17 a side).

    Ratios to the mode's probability are multiplied up and scaled to sum 1, so nothing underflows at large rates.
    """
    mode, spread = math.floor(rate), 9 * math.sqrt(rate)
    first, last = max(0, math.floor(rate - spread)), math.ceil(rate + spread) + 27
    down = np.cumprod(np.arange(mode, first, -1) / rate)[::-1]
    up = np.cumprod(rate / np.arange(mode + 1, last + 1))
    p = np.concatenate([down, [1.0], up])
    return first, np.cumsum(p / p.sum())


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of MD5, the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str | None, float], default_weight: float, size: float | None, source_col: str) -> DataFrame:
    """source, rate: the mean number of copies of a document; ``size`` is the output's expected number of rows (input's if None)."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighted = counts.withColumn("weight", weight)
    total = weighted.agg(F.sum("weight").alias("w"), F.sum("n").alias("t")).first()
    rows = float(size) if size is not None else float(total.t or 0)
    rate = F.col("weight") * (rows / total.w if total.w else 0.0) / F.col("n")
    return weighted.select("source", rate.alias("rate"), "n")


def mix_sources(docs: DataFrame, weights: dict[str | None, float], seed: int = 7, default_weight: float = 0.0, size: float | None = None, partitions: int | None = None, small: int = 100_000, most: int = 400, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of docs, then mix_copy (from 0), mix_copies and mix_key, dealt and ordered by mix_key.

    Columns of docs by these three names are replaced; all others stay, whatever they are called.
    """
    kept = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_copies", "mix_key")]
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), name.alias("name"), F.col(source_col).alias("own_source"))
    # the steps are computed once per source, not once per document
    rates = source_rates(docs, weights, default_weight, size, source_col).where("rate > 0").select(F.col("source").alias("mix_source"), "rate")
    near = rates.where(F.col("rate") <= most / 2).select("mix_source", F.lit(0).alias("mix_first"), poisson_steps(F.col("rate"), most).alias("mix_steps"))

    def far(batches):
        for pdf in batches:
            steps = [far_steps(r) for r in pdf["rate"]]
            yield pd.DataFrame({"mix_source": pdf["mix_source"], "mix_first": [x[0] for x in steps], "mix_steps": [x[1] for x in steps]})

    kind = rates.schema["mix_source"].dataType.simpleString()
    rates = near.unionAll(rates.where(F.col("rate") > most / 2).mapInPandas(far, f"mix_source {kind}, mix_first int, mix_steps array<double>"))
    joined = rows.join(broadcast_if_small(rates, small), F.col("own_source").eqNullSafe(F.col("mix_source")))
    drawn = joined.withColumn("mix_copies", F.col("mix_first") + poisson_inverse(unit_hash(F.lit(str(seed)), F.col("name")), F.col("mix_steps"))).where("mix_copies > 0")
    copies = drawn.select("doc", "name", "mix_copies", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)).alias("mix_copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}s"), "name", F.col("mix_copy").cast("string")).cast("binary"))
    keyed = copies.select("doc.*", "mix_copy", "mix_copies", key.alias("mix_key"))
    if partitions is None:
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((planned_bytes(docs) or 0) / (64 << 20)))
    return keyed.repartition(partitions, "mix_key").sortWithinPartitions("mix_key")
