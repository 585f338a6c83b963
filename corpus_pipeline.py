"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is all its predecessor kept, and returns a DataFrame; all
but the last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet to the
shared folder and reads it again for the next one, so lineage ends at every stage and a lost executor costs
that stage's tasks at most.

Cases: null and empty texts are not toxic, near duplicates of nothing and clean, and pass; repeated rows of
one id and text are one document to the join stage and one of them stays; an empty table passes through.
Mixing gives null and unlisted sources ``MIX_DEFAULT``; the token stage takes a null text as an empty one and
orders null ids first.  Extra columns of the input table are left out by ``run``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.llm.decontam import decontaminate
from curvelake.llm.jaccard import jaccard_classes
from curvelake.llm.mixing import mix_sources
from curvelake.llm.queries import END_ID, MIX_DEFAULT, MIX_SEED, MIX_WEIGHTS, fold, table
from curvelake.llm.scratch import Scratch
from curvelake.llm.tokens import token_index
from curvelake.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half stay."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    scored = score_toxicity(docs, model, [F.col(c).alias(f"kept_{c}") for c in COLUMNS])
    return scored.where("predicted = 0").select(*(F.col(f"kept_{c}").alias(c) for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    kept = jaccard_classes(docs).where("is_first").select("row_key").distinct()
    keyed = docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"))
    return keyed.join(kept, "row_key").dropDuplicates(["row_key"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item stay."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_key").distinct()
    dirty = found.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key"))
    return docs.select(*COLUMNS).join(dirty, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_key")), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their sources' rates, in a global shuffle's order."""
    return mix_sources(docs, MIX_WEIGHTS, seed=MIX_SEED, default_weight=MIX_DEFAULT).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; one row per document copy, as read back from them."""
    import public_tokenizers

    return token_index(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: Trained scores, minhash candidates and token ids have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
