"""Column expressions and steps that the native operators share: no Python runs on the executors."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that doesn't belong to a word, after A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hash value of the row that stands before a text's first word.
HEAD = -6148914691236517206


def words(text: Column) -> Column:
    """An empty string, then the words; another empty string may follow the last one."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.split(F.concat(F.lit(" "), lowered), NOT_WORD)


def n_words(array: Column) -> Column:
    last = F.element_at(array, -1)
    return (F.size(array) - 1 - F.when((F.size(array) > 1) & (last == ""), 1).otherwise(0)).cast("long")


def gram(array: Column, at: Column | int, n: int) -> Column:
    """A 64-bit hash of n words from a position on; positions beyond the end hash as if absent."""
    return F.xxhash64(F.lit(n), *(F.get(array, (F.lit(at) if isinstance(at, int) else at) + j) for j in range(n)))


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per word, and one before them (pos 0): doc_id, text_key, w (the whole array), n_words, pos.

    text_key tells rows of one id with different texts apart; equal rows stay together and are counted by
    their pos 0.  posexplode_outer, as Spark would otherwise split each text once more for a filter.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), words(F.col(text_col)).alias("w"))
    return base.select("doc_id", "text_key", "w", F.posexplode_outer("w").alias("pos", "word")).select("doc_id", "text_key", "w", n_words(F.col("w")).alias("n_words"), "pos")


def each_copy(df: DataFrame, copies: str) -> DataFrame:
    """A row for each repeated input row."""
    return df.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copies)
