"""Language identification by words first, then ever shorter character n-grams.

A known word adds its log frequency in each language.  An unseen word adds the mean log frequency of its
character n-grams of the longest length of which any is known, from ``longest`` down to 1; word edges are
marked.  The language with the largest sum wins; the score is its posterior under equal priors.

The model is learned from a bounded sample: of each language about ``per_language`` labelled rows and
``most_chars`` characters, picked by id hash.  All their words and n-grams are in it: Spark counts them, packs
the tables of log frequencies into a few rows, and the driver only passes these bytes on to the tasks, whose
size follows the sample's.  Prediction reads whole texts, nothing else.

Cases: a null text, or one without a letter, is ``und`` with score 0; letters of which no n-gram is known
get the most frequent learned language with score 1 / languages; of languages that are equally likely the
first by name is taken; without labelled rows all is ``und``; repeated rows each get their row; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> Counter:
    """Lower-cased runs of letters with their counts."""
    found = Counter(_WORDS(text.lower())) if text else Counter()
    for w in [] if all(map(str.isalpha, found)) else [w for w in found if not w.isalpha()]:  # signs such as fractions count as word characters
        n, letters = found.pop(w), "".join(c for c in w if c.isalpha())
        if letters:
            found[letters] += n
    return found


def grams(word: str, k: int) -> list[str]:
    """Character n-grams, of words with marked edges but for single characters; k = 0: the word itself."""
    if k == 0:
        return [word]
    if k == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + k] for i in range(len(marked) - k + 1)]


class LanguageModel:
    """Log frequencies of words (length 0) and of n-grams by language.

    Its tables stay packed until a task asks: keys joined by line feeds, and a row of float32 for each key.
    """

    def __init__(self, languages: list[str], totals: list[float], packed: list[tuple[int, bytes, bytes]], longest: int = 5):
        self.languages, self.totals, self.packed, self.longest = languages, totals, packed, longest

    @classmethod
    def of_counts(cls, counts: dict[tuple[str, str], int], longest: int = 5, alpha: float = 0.1) -> LanguageModel:
        """counts: of (language, word); the same tables that learn_languages has Spark count."""
        languages = sorted({k[0] for k in counts})
        packed, totals = [], np.zeros(len(languages))
        for k in range(longest + 1):
            table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
            for (language, word), c in counts.items():
                for g in grams(word, k):
                    table[g][languages.index(language)] += c
            rows = np.stack(list(table.values())) if table else np.zeros((0, len(languages)))
            totals = rows.sum(axis=0) if k == 0 else totals
            packed.append(pack_table(k, list(table), rows, rows.sum(axis=0) + alpha * len(rows), alpha))
        return cls(languages, totals.tolist(), packed, longest)

    def tables(self) -> None:
        """Dictionaries of row numbers, and one array of rows for all lengths."""
        n = max(len(self.languages), 1)
        self.rows_of: list[dict[str, int]] = [{} for _ in range(self.longest + 1)]
        logs, first = [np.zeros((0, n), dtype=np.float32)], 0
        for k, keys, raw in self.packed:
            rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.float32).reshape(-1, n)
            names = zstandard.ZstdDecompressor().decompress(keys).decode().split("\n") if len(rows) else []
            self.rows_of[k].update(zip(names, range(first, first + len(names)), strict=True))
            logs.append(rows)
            first += len(rows)
        self.logs = np.concatenate(logs)

    def rows(self, word: str) -> list[int]:
        """The word's own row, else those of its known n-grams of the longest length that has any."""
        if (i := self.rows_of[0].get(word)) is not None:
            return [i]
        for k in range(self.longest, 0, -1):
            get = self.rows_of[k].get
            found = [i for g in grams(word, k) if (i := get(g)) is not None]
            if found:
                return found
        return []

    def predictor(self, limit: int = 400_000):
        """A function of a text; it remembers words, up to a number, which changes no result."""
        self.tables()
        usual = self.languages[int(np.argmax(self.totals))] if self.languages else "und"
        known: dict[str, int] = {}
        store = np.zeros((1024, len(self.languages)), dtype=np.float32)

        def learn(fresh: list[str]) -> None:
            nonlocal store
            rows = [self.rows(w) for w in fresh]
            n = np.array([len(r) for r in rows])
            first = len(known)
            while len(store) < first + len(fresh):
                store = np.concatenate([store, np.zeros_like(store)])
            filled = np.flatnonzero(n)
            store[first : first + len(fresh)] = 0
            if len(filled):
                flat = np.fromiter((i for r in rows for i in r), np.int64, int(n.sum()))
                store[first + filled] = np.add.reduceat(self.logs[flat], (np.cumsum(n) - n)[filled], axis=0) / n[filled, None]
            known.update(zip(fresh, range(first, first + len(fresh)), strict=True))

        def predict(text: str | None) -> tuple[str, float]:
            found = words_of(text)
            if not found or not self.languages:
                return "und", 0.0
            if len(known) > limit:
                known.clear()
            if fresh := [w for w in found if w not in known]:
                learn(fresh)
            at = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
            sums = np.fromiter(found.values(), np.float32, len(found)) @ store[at]
            if not sums.any():
                return usual, 1.0 / len(self.languages)
            odds = np.exp((sums - sums.max()).astype(np.float64))
            best = int(np.argmax(sums))
            return self.languages[best], float(min(1.0, odds[best] / odds.sum()))

        return predict


def pack_table(k: int, keys: list[str], counts: np.ndarray, totals: np.ndarray, alpha: float) -> tuple[int, bytes, bytes]:
    """Keys of length k and their log frequencies; ``totals`` holds each language's sum over the whole table, smoothing included."""
    logs = np.log((counts + alpha) / np.maximum(totals, 1e-300)).astype(np.float32)
    zip_ = zstandard.ZstdCompressor(level=3).compress
    return k, zip_("\n".join(keys).encode()), zip_(logs.tobytes())


def sample_by_key(rows: DataFrame, key: Column, by: str, most: int, size: str | None = None, most_size: int = 0) -> DataFrame:
    """About ``most`` rows for each value of ``by`` (all where there are fewer), picked by a hash of ``key``.

    With ``size``, a column of numbers, the sizes of a value's rows add up to about ``most_size`` at most.
    """
    # one row a label value reaches the driver
    counts = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(size or F.lit(0)).alias("size")).collect()
    keep = F.lit(False)
    for r in counts:
        share = min(1.0, most / r.n, most_size / r.size if size and r.size else 1.0)
        keep = F.when(F.col(by) == r[by], F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_003)) < int(1_000_003 * share)).otherwise(keep)
    return rows.where(keep)


def learn_languages(docs: DataFrame, train: Column, per_language: int = 3000, most_chars: int = 24_000_000, longest: int = 5, alpha: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(train, F.lit(True)).alias("train")).where("train and lang is not null and text is not null")
    sample = sample_by_key(labelled.withColumn("chars", F.length("text")), F.col("doc_id"), "lang", per_language, "chars", most_chars).select("lang", "text")

    def count(batches):
        totals: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, c in words_of(text).items():
                    totals[lang, w] += c
            if len(totals) > 500_000:
                yield _rows([(a, 0, w, c) for (a, w), c in totals.items()])
                totals.clear()
        yield _rows([(a, 0, w, c) for (a, w), c in totals.items()])

    def split(batches):
        for batch in batches:
            totals: Counter = Counter()
            for lang, _, word, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for k in range(1, longest + 1):
                    for g in grams(word, k):
                        totals[lang, k, g] += n
            yield _rows([(*key, n) for key, n in totals.items()])

    def _rows(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "k", "g", "n"])

    schema = "lang string, k int, g string, n long"
    scratch = Scratch(docs.sparkSession, "langid")
    words = scratch.write("words", sample.mapInArrow(count, schema).groupBy("lang", "k", "g").agg(F.sum("n").alias("n")))
    per_key = words.unionAll(words.mapInArrow(split, schema)).groupBy("k", "g", "lang").agg(F.sum("n").alias("n")).groupBy("k", "g").agg(F.collect_list(F.struct("lang", "n")).alias("own"))  # a value per language
    keys = scratch.write("keys", per_key)
    sums = keys.select("k", F.explode("own").alias("o")).groupBy("k", "o.lang").agg(F.sum("o.n").alias("n")).collect()
    sizes = {r.k: r["count"] for r in keys.groupBy("k").count().collect()}
    languages = sorted({r.lang for r in sums})
    at = {x: i for i, x in enumerate(languages)}
    totals = np.zeros((longest + 1, len(languages)))
    for r in sums:
        totals[r.k, at[r.lang]] += r.n

    def pack(batches):
        held: dict[int, tuple[list[str], list[list[dict]]]] = {}
        for batch in batches:
            for k, g, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names, values = held.setdefault(k, ([], []))
                names.append(g)
                values.append(own)
        for k, (names, values) in held.items():
            counts = np.zeros((len(names), len(languages)))
            for i, own in enumerate(values):
                for o in own:
                    counts[i, at[o["lang"]]] = o["n"]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(pack_table(k, names, counts, totals[k] + alpha * sizes[k], alpha), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["k", "keys", "logs"])

    packed = [(r.k, bytes(r["keys"]), bytes(r.logs)) for r in keys.mapInArrow(pack, "k int, keys binary, logs binary").collect()]
    scratch.drop()
    return LanguageModel(languages, totals[0].tolist(), packed, longest)


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[Column] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the columns of ``keep``, lang_pred, score."""
    src = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    names = src.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", lang_pred string, score double"

    def run(batches):
        predict = model.predictor()
        for batch in batches:
            got = [predict(t.as_py()) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return src.mapInArrow(run, schema)
