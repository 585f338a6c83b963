"""Quality rules by repetition coverage.

For each text, rolling hashes of several n-gram lengths mark every word that lies in an n-gram found
twice or more in the same text; the share of the text's word characters inside marked words is its
coverage for that length.  Duplicated lines are measured the same way.  All in numpy over whole blocks
of texts: per n one sort of 64-bit keys, no Python per word.

Cases: a null or empty text (or one of white space only) has zero counts, coverage 0 and fails the base
rule, as it has under ``min_words`` words.  Repeated rows each get their row.  Columns other than the id
and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Base limits, and the largest coverage allowed per n-gram length, for duplicated lines and for symbols."""

    min_words: int = 50
    max_repeat_percent: int = 50
    coverage: dict[int, float] = field(default_factory=lambda: {3: 0.5, 5: 0.45, 8: 0.4, 10: 0.4})
    dup_line_chars: float = 0.3
    symbol_share: float = 0.1


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _marked(hashes: np.ndarray, words: T.Words, n: int) -> np.ndarray:
    """True for words inside an n-word window that its text holds twice or more."""
    grams, at = T.ngrams(hashes, words.doc, n)
    twice = at[T.repeated(T.tagged(grams, words.doc[at]))]
    edges = np.zeros(len(hashes) + 1, dtype=np.int32)
    edges[twice] += 1
    np.subtract.at(edges, twice + n, 1)
    return np.cumsum(edges[:-1]) > 0


def measure(block: T.Block, rules: Rules) -> dict[str, np.ndarray]:
    words = block.words(T.SPACED)
    hashes = block.hashes(words.start, words.end)
    leads = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=leads[1:])
    chars = leads[words.end] - leads[words.start]
    out = {"n_words": np.diff(words.first), "word_chars": T.per_doc(chars, words.first)}
    out["n_symbols"] = T.per_doc(SYMBOLS[block.data], block.offset)
    whole = np.maximum(out["word_chars"], 1)

    lines = block.spans(block.data != 0x0A)
    in_line = np.searchsorted(words.start, np.stack([lines.start, lines.end]))
    held = in_line[1] > in_line[0]
    keys = T.tagged(block.hashes(lines.start[held], lines.end[held]), lines.doc[held])
    seen, first_at = np.unique(keys, return_index=True)
    later = np.ones(len(keys), dtype=bool)
    later[first_at] = False
    doc = lines.doc[held][later]
    out["n_dup_lines"] = np.bincount(doc, minlength=len(block)).astype(np.int64)
    of_word = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars, out=of_word[1:])
    line_chars = (of_word[in_line[1]] - of_word[in_line[0]])[held][later]
    out["dup_line_chars"] = np.bincount(doc, weights=line_chars, minlength=len(block)) / whole

    for n in sorted({3, *rules.coverage}):
        marked = _marked(hashes, words, n)
        if n == 3:
            out["n_repeat_words"] = T.per_doc(marked, words.first)
        if n in rules.coverage:
            out[f"cover_{n}"] = T.per_doc(np.where(marked, chars, 0), words.first) / whole

    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    bad = (out["dup_line_chars"] > rules.dup_line_chars) | (out["n_symbols"] > rules.symbol_share * whole)
    for n, most in rules.coverage.items():
        bad = bad | (out[f"cover_{n}"] > most)
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def repetition_quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds nothing to the rows but the measures: id, base counts, coverage per n (cover_n), dup_line_chars, base_failed, kept."""
    src = docs.select(id_col, text_col)
    covers = [f"cover_{n}" for n in rules.coverage]
    schema = f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, {SCHEMA}, dup_line_chars double, {', '.join(f'{c} double' for c in covers)}"
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *covers]

    def run(batches):
        for batch in batches:
            for block in T.blocks(batch.column(1)):
                got = measure(block, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row, len(block)), *(pa.array(got[c]) for c in names)], names=[id_col, *names])

    return src.mapInArrow(run, schema)
