"""The registered queries of the operators and of the pipeline: thin layers over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import decontaminate
from .html_text import extract_text
from .interpolation import interpolated_scores
from .jaccard import jaccard_classes
from .langid import learn_languages, predict_language
from .licenses import license_scan
from .line_dedup import drop_common_lines
from .mixing import mix_sources
from .repetition import Rules, repetition_quality
from .resample import importance_resample
from .runs import periodic_runs
from .tokens import token_index
from .toxicity import fit_toxicity, score_toxicity

#: Target weights of the sources src0 to src19: the hot source is held to a twentieth, the others fall evenly.
MIX_WEIGHTS = {"src0": 1.0, **{f"src{i}": 0.5 + 0.05 * i for i in range(1, 20)}}
#: The weight of any other source, null included.
MIX_DEFAULT = 1.0
MIX_SEED = 7
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo a number; -1 for a null id, which is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1))


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, MIX_WEIGHTS, seed=MIX_SEED, default_weight=MIX_DEFAULT)
    return mixed.select("doc_id", "source", "mix_copy", "mix_copies", "mix_key", F.length("text").cast("long").alias("text_chars"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs, fold(3) != 1)
    return predict_language(docs, model, [(fold(3) == 1).alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return score_toxicity(docs, model, [(fold(5) == 0).alias("held_out")])


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("text_key")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("row_key", "is_first")


def op9_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = interpolated_scores(docs, fold(5) != 1, fold(50) % 10 == 2)
    return scored.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, n_max=1, n_buckets=10_000, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def with_repetition(docs: DataFrame) -> DataFrame:
    """One document in ten by a hash of its id, with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    listed = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"), F.size(words).alias("n"))
    placed = listed.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)
    repeated = F.transform(at, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("w").isNotNull() & (F.col("n") > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repetition(table(spark, sf_dir, "documents")), min_words=6, exponent=4)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digests = (F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = [op1_poisson_mix, op2_html_text, op3_language, op4_repetition, op5_decontamination, op6_toxicity, op7_licenses, op8_jaccard_join, op9_interpolation, op10_token_shards, op11_importance_resample, op12_periodic_runs, op13_line_dedup, pipeline]
    return {f.__name__: f for f in found}


_DRAWN = """
WITH weights AS (
    SELECT * FROM (VALUES {weights}) AS t(source, weight)
), sources AS (
    SELECT d.source, count(*) AS n, any_value(coalesce(w.weight, {default})) AS weight FROM documents d LEFT JOIN weights w ON d.source = w.source GROUP BY d.source
), rates AS (
    SELECT source, weight / (SELECT sum(weight) FROM sources) * (SELECT sum(n) FROM sources) / n AS rate FROM sources
), steps AS (
    SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, (SELECT unnest(range(0, 400)) AS k)
), below AS (
    SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps
), upto AS (
    SELECT source, list(c ORDER BY k) AS cs FROM below GROUP BY source
), drawn AS (
    SELECT d.doc_id, d.source, length(d.text) AS text_chars,
           len(list_filter(u.cs, lambda c: c < (('0x' || substr(md5('{seed}|' || d.doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496)) AS n
    FROM documents d JOIN upto u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, source, k::INT AS mix_copy, n::INT AS mix_copies, md5('{seed}s|' || doc_id || '|' || k) AS mix_key, text_chars
FROM (SELECT *, unnest(range(0, n)) AS k FROM drawn WHERE n > 0)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_HELD = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM grams JOIN wins USING (g, n)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


_LINES = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, i, l[i] AS line FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM docs)),
keyed AS (SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT r, i, line, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY r) JOIN docs USING (r)
"""


def _repetition_sql() -> str:
    """Counts and coverages of op4 with the default rules, by plain window strings."""
    rules = Rules()
    spaced = r"[^\x20\x09-\x0D]+"
    parts = [
        f"docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{spaced}') AS w FROM documents)",
        "words AS (SELECT r, i, length(w[i]) AS chars FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs))",
        "base AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols FROM docs)",
        f"lines AS (SELECT r, line, k, coalesce(list_sum(list_transform(regexp_extract_all(line, '{spaced}'), lambda x: length(x))), 0) AS chars FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM docs))",
        "dups AS (SELECT r, count(*) AS n_dup_lines, sum(chars) AS dup_chars FROM (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth FROM lines WHERE chars > 0) WHERE nth > 1 GROUP BY r)",
    ]
    for n in sorted({3, *rules.coverage}):
        parts.append(f"g{n} AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM (SELECT r, i, array_to_string(w[i:i + {n} - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM docs WHERE len(w) >= {n})))")
        parts.append(f"c{n} AS (SELECT r, count(*) AS marked, sum(chars) AS chars FROM (SELECT DISTINCT r, unnest(range(i, i + {n})) AS i FROM g{n} WHERE c > 1) JOIN words USING (r, i) GROUP BY r)")
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.r = b.r" for n in sorted({3, *rules.coverage}))
    cover = ", ".join(f"coalesce(c{n}.chars, 0)::DOUBLE / greatest(word_chars, 1) AS cover_{n}" for n in rules.coverage)
    bad = " OR ".join([f"dup_line_chars > {rules.dup_line_chars}::DOUBLE", f"n_symbols > {rules.symbol_share}::DOUBLE * greatest(word_chars, 1)", *(f"cover_{n} > {most}::DOUBLE" for n, most in rules.coverage.items())])
    parts.append(
        f"measured AS (SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c3.marked, 0) AS n_repeat_words, n_words < {rules.min_words} OR 100 * coalesce(c3.marked, 0) > {rules.max_repeat_percent} * n_words AS base_failed, "
        f"coalesce(dup_chars, 0)::DOUBLE / greatest(word_chars, 1) AS dup_line_chars, {cover} FROM base b LEFT JOIN dups ON dups.r = b.r {joins})"
    )
    return "WITH " + ", ".join(parts) + f" SELECT *, NOT (base_failed OR {bad}) AS kept FROM measured"


def oracle_sql():
    weights = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in MIX_WEIGHTS.items())
    return {"op1_poisson_mix": _DRAWN.format(weights=weights, seed=MIX_SEED, default=f"{MIX_DEFAULT}::DOUBLE"), "op4_repetition": _repetition_sql(), "op5_decontamination": _HELD, "op13_line_dedup": _LINES}
