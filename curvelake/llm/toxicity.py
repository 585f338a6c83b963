"""Toxicity by a linear-chain conditional random field over tokens.

Labels mark documents, the field needs labelled tokens: a token of a toxic document is labelled toxic if its
word, or one of its prefixes or suffixes, occurs in toxic documents far more often than chance lets it
(binomial tail below ``chance`` and at least ``purity`` of the documents that have it).  The field then learns
weights of these features and of the transitions by gradient ascent on the likelihood; forward-backward
gives each token's marginal.  A document's score is a logistic function of its largest marginal and of the
expected number of tokens in toxic spans, fitted on the document labels.

Learning uses a bounded sample: of each label about ``most_rows`` labelled rows and ``most_chars`` characters,
picked by id hash, whole texts of any length.  One executor task learns from it and returns the model's
weights; neither texts nor features come to the driver.  In training, the field sees a text as sequences of
at most ``piece`` tokens; scoring runs over whole texts.

Cases: null, empty and wordless texts have no marginals and get the score of a text without toxic tokens;
without labels of both kinds every score is 0; repeated rows each get their row; an empty table gives none.
Offsets of spans are characters of the text as it came, also where lower case is longer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .jaccard import minhash, shingles
from .langid import sample_by_key

_TOKENS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word, and its edges if it is long enough to have some."""
    n = len(word)
    out = ["w" + word]
    out += [f"p{word[:k]}" for k in (4, 5) if n >= k]
    out += [f"s{word[-k:]}" for k in (4, 5) if n >= k]
    return out


def tokens(text: str | None) -> list[str]:
    """Lower-cased tokens, one for each match in the text as it came."""
    if not text:
        return []
    lowered = text.lower()
    return _TOKENS.findall(lowered) if len(lowered) == len(text) else [w.lower() for w in _TOKENS.findall(text)]


class Steps:
    """Token positions of many sequences in the order of time: first tokens, second tokens, ..., longest sequences first."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        size = length[order]
        self.active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        self.base = np.concatenate([[0], np.cumsum(self.active)])
        step = np.repeat(np.arange(len(self.active)), self.active)
        self.at = first[order][np.arange(len(step)) - self.base[step]] + step

    def odds(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds (toxic to clean) of every token; emit is in the order of time.

        emit: exp of the toxic label's advantage at each token; move[i, j]: exp of the weight of i -> j.
        """
        forward, backward = np.empty(len(emit)), np.ones(len(emit))
        (oo, ot), (to, tt) = move
        r = np.zeros(0)
        for t, n in enumerate(self.active):
            here = slice(self.base[t], self.base[t + 1])
            if t:
                r = r[:n]
                r = emit[here] * (ot + tt * r) / (oo + to * r)
            else:
                r = emit[here].copy()
            np.minimum(np.maximum(r, 1e-30, out=r), 1e30, out=r)
            forward[here] = r
        for t in range(len(self.active) - 2, -1, -1):
            n = self.active[t + 1]
            ahead = slice(self.base[t + 1], self.base[t + 2])
            r = emit[ahead] * backward[ahead]
            r = (to + tt * r) / (oo + ot * r)
            np.minimum(np.maximum(r, 1e-30, out=r), 1e30, out=backward[self.base[t] : self.base[t] + n])
        return forward, backward

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions, in the order of time, of tokens with a next one and of these next ones."""
        n = self.active[1:]
        step = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(step)) - (np.cumsum(n) - n)[step]
        return self.base[step] + k, self.base[step + 1] + k


def chain_odds(emit: np.ndarray, first: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the tokens of sequences that stand one after the other."""
    steps = Steps(first, length)
    out = np.empty(len(emit)), np.empty(len(emit))
    for whole, own in zip(out, steps.odds(emit[steps.at], move), strict=True):
        whole[steps.at] = own
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    move: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    head: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def doc_score(self, top: np.ndarray, mass: np.ndarray) -> np.ndarray:
        a, b, c = self.head
        return 1 / (1 + np.exp(-np.clip(a + b * top + c * np.log1p(mass), -500, 500)))

    def scorer(self, limit: int = 400_000):
        known: dict[str, float] = {}

        def score(texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
            words = [tokens(t) for t in texts]
            if len(known) > limit:
                known.clear()
            for w in set().union(*words).difference(known):
                known[w] = exp(max(-60.0, min(60.0, self.emission(w))))
            length = np.array([len(w) for w in words], dtype=np.int64)
            first = np.cumsum(length) - length
            emit = np.fromiter((x for w in words for x in map(known.__getitem__, w)), np.float64, int(length.sum()))
            forward, backward = chain_odds(emit, first, length, self.move)
            odds = forward * backward
            p = odds / (1 + odds)
            top, mass, spans = self._totals(p, first, length), np.zeros(len(texts)), [[] for _ in texts]
            likely = np.flatnonzero(p >= 0.5)
            doc = np.searchsorted(first, likely, side="right") - 1
            np.add.at(mass, doc, p[likely])
            for i in np.unique(doc):
                spans[i] = self._spans(texts[i], (likely[doc == i] - first[i]).tolist(), p[first[i] :])
            return self.doc_score(top, mass), spans

        return score

    @staticmethod
    def _totals(p: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        top = np.zeros(len(first))
        filled = length > 0
        if filled.any():
            top[filled] = np.maximum.reduceat(p, first[filled])
        return top

    @staticmethod
    def _spans(text: str, at: list[int], p: np.ndarray) -> list[dict]:
        """Runs of toxic tokens as character offsets in the text as it came."""
        places = [m.span() for m in _TOKENS.finditer(text)]
        out: list[dict] = []
        last = -2
        for k in at:
            if k == last + 1:
                out[-1] |= {"end": places[k][1], "probability": max(out[-1]["probability"], float(p[k]))}
            else:
                out.append({"start": places[k][0], "end": places[k][1], "probability": float(p[k])})
            last = k
        return out


def _log_tail(k: int, n: int, q: float) -> float:
    """Logarithm of P(Binomial(n, q) >= k), by its largest terms."""
    terms = [lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(q) + (n - j) * log(1 - q) for j in range(k, min(n, k + 200) + 1)]
    top = max(terms)
    return top + log(sum(exp(t - top) for t in terms))


def distinct_texts(texts: list[str], bands: int = 8) -> list[int]:
    """Indexes of texts that are no near copies of earlier ones: copies are no independent evidence of a mark."""
    kept, seen = [], set()
    for block in T.blocks(pa.array(texts, pa.string()), lower=True):
        keys, first = shingles(block, 3)
        sig = minhash(keys, first, 2 * bands).reshape(len(block), bands, 2)
        for i, row in enumerate(sig.tolist()):
            own = {(b, *pair) for b, pair in enumerate(row)}
            if first[i] == first[i + 1] or seen.isdisjoint(own):
                kept.append(block.row + i)
                seen |= own
    return kept


class _Coded:
    """Texts as codes of a vocabulary, and the features of each word, all in flat arrays."""

    def __init__(self, texts: list[str]):
        self.vocabulary: dict[str, int] = {}
        setdefault = self.vocabulary.setdefault
        self.docs = [np.fromiter((setdefault(w, len(self.vocabulary)) for w in tokens(t)), np.int32) for t in texts]
        self.names: dict[str, int] = {}
        counts, flat = [], []
        for w in self.vocabulary:
            own = features(w)
            counts.append(len(own))
            flat += [self.names.setdefault(f, len(self.names)) for f in own]
        self.count, self.feature_of = np.array(counts, dtype=np.int64), np.array(flat, dtype=np.int32)
        self.begin = np.cumsum(self.count) - self.count
        self.word_of = np.repeat(np.arange(len(counts)), self.count)

    def features_of(self, doc: np.ndarray) -> np.ndarray:
        words = np.unique(doc)
        n = self.count[words]
        at = np.repeat(self.begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.unique(self.feature_of[at])

    def by_word(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.word_of, weights=weights[self.feature_of], minlength=len(self.count))

    def flat(self, pick) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        docs = [self.docs[i] for i in pick]
        length = np.array([len(d) for d in docs], dtype=np.int64)
        return np.concatenate(docs) if docs else np.zeros(0, np.int32), np.cumsum(length) - length, length


def cut_pieces(length: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of the pieces of at most ``piece`` tokens that follow each other in texts of these lengths."""
    n = -(-length // piece)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(length) - length, n) + nth * piece
    return first, np.minimum(piece, np.repeat(length, n) - nth * piece)


def learn_toxicity(texts: list[str], labels: list[int], chance: float = 1e-5, purity: float = 0.85, piece: int = 128, rounds: int = 40) -> ToxicityModel:
    kept = distinct_texts(texts)
    y = np.array([labels[i] for i in kept])
    if len(set(y.tolist())) < 2:
        return ToxicityModel()
    coded = _Coded([texts[i] for i in kept])
    n_features = len(coded.names)
    toxic, all_ = np.zeros(n_features, dtype=np.int64), np.zeros(n_features, dtype=np.int64)
    for doc, label in zip(coded.docs, y, strict=True):
        own = coded.features_of(doc)
        all_[own] += 1
        toxic[own] += label
    share, mark = float(y.mean()), np.zeros(n_features, dtype=bool)
    for f in np.flatnonzero((toxic >= 3) & (toxic >= purity * all_)):
        mark[f] = _log_tail(int(toxic[f]), int(all_[f]), share) < log(chance)
    if not mark.any():
        return ToxicityModel()

    marked = coded.by_word(mark.astype(float)) > 0
    flat, _, length = coded.flat(range(len(y)))
    n_words, word_of, feature_of = len(coded.count), coded.word_of, coded.feature_of
    target = (marked[flat] & np.repeat(y == 1, length)).astype(np.float64)
    chain = Steps(*cut_pieces(length, piece))
    flat, target = flat[chain.at], target[chain.at]
    here, next_ = chain.pairs()
    seen = np.bincount((2 * target[here] + target[next_]).astype(np.int64), minlength=4).reshape(2, 2)
    w, bias, trans = np.zeros(n_features), log((target.sum() + 1) / max(len(flat), 1)), np.zeros((2, 2))
    square = [np.full(n_features, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(rounds):
        emit = np.exp(np.clip(bias + coded.by_word(w), -60, 60))[flat]
        move = np.exp(trans)
        forward, backward = chain.odds(emit, move)
        odds = forward * backward
        miss = target - odds / (1 + odds)
        ahead, before = emit[next_] * backward[next_], forward[here]
        own = before * (move[1, 0] + move[1, 1] * ahead)
        total = move[0, 0] + move[0, 1] * ahead + own
        toxic_before, toxic_ahead, both = (own / total).sum(), ((move[0, 1] + move[1, 1] * before) * ahead / total).sum(), (move[1, 1] * before * ahead / total).sum()
        expected = np.array([[len(here) - toxic_before - toxic_ahead + both, toxic_ahead - both], [toxic_before - both, both]])
        by_word = np.bincount(flat, weights=miss, minlength=n_words)
        steps = [np.bincount(feature_of, weights=by_word[word_of], minlength=n_features) - 0.05 * w, miss.sum(), seen - expected - 0.05 * trans]
        for k, g in enumerate(steps):
            square[k] = square[k] + g**2
        w = w + 0.7 * steps[0] / np.sqrt(square[0])
        bias = bias + 0.7 * steps[1] / np.sqrt(square[1])
        trans = trans + 0.3 * steps[2] / np.sqrt(square[2])
    w[np.abs(w) <= 1e-3] = 0
    model = ToxicityModel({f: float(w[k]) for f, k in coded.names.items() if w[k]}, float(bias), np.exp(trans))

    emission = np.exp(np.clip(bias + coded.by_word(w), -60, 60))
    top, mass = np.zeros(len(y)), np.zeros(len(y))
    for k in range(0, len(y), 500):
        part = range(k, min(k + 500, len(y)))
        flat, first, length = coded.flat(part)
        forward, backward = chain_odds(emission[flat], first, length, model.move)
        p = forward * backward / (1 + forward * backward)
        top[part] = model._totals(p, first, length)
        np.add.at(mass, k + np.repeat(np.arange(len(length)), length), np.where(p >= 0.5, p, 0))
    x = np.stack([np.ones(len(y)), top, np.log1p(mass)], axis=1)
    beta = np.zeros(3)
    for _ in range(40):  # Newton's method with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x.T * (q * (1 - q))) @ x + 0.05 * np.eye(3), x.T @ (y - q) - 0.05 * beta)
    model.head = tuple(float(b) for b in beta)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, train: Column, most_rows: int = 3000, most_chars: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The bounded sample: doc_id, text, label."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null").where(F.coalesce(train, F.lit(False))).groupBy("doc_id").agg(F.max("label").alias("label"))
    fitting = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    sized = known.join(fitting.select("doc_id", F.length("text").alias("chars")), "doc_id").groupBy("doc_id", "label").agg(F.max("chars").alias("chars"))
    sample = sample_by_key(sized, F.col("doc_id"), "label", most_rows, "chars", most_chars).select("doc_id", "label")  # within the bounds, so small enough to broadcast
    return fitting.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"]).select("doc_id", "text", "label")


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, piece: int = 128, **sample) -> ToxicityModel:
    """``train`` is an expression over doc_id; repeated label rows of an id count as toxic if one does; ``sample``: see training_rows."""

    def fit(batches):
        if not (held := list(batches)):
            return
        own = pa.Table.from_batches(held).to_pandas().sort_values(["doc_id", "text"])
        model = learn_toxicity(own["text"].tolist(), own["label"].astype(int).tolist(), piece=piece)
        numbers = [model.bias, *model.move.reshape(-1).tolist(), *model.head]
        del own, held
        T.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([list(model.weights)], pa.list_(pa.string())), pa.array([list(model.weights.values())], pa.list_(pa.float64())), pa.array([numbers], pa.list_(pa.float64()))], names=["names", "weights", "numbers"])

    learned = training_rows(docs, labels, train, **sample).coalesce(1).mapInArrow(fit, "names array<string>, weights array<double>, numbers array<double>").first()
    if learned is None:
        return ToxicityModel()
    bias, a, b, c, d, *head = learned.numbers
    return ToxicityModel(dict(zip(learned.names, learned.weights, strict=True)), bias, np.array([[a, b], [c, d]]), tuple(head))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[Column] = (), id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 20) -> DataFrame:
    """The id, the columns of ``keep``, score, predicted, spans (character offsets of toxic tokens); about ``chunk`` bytes of texts go through the field at once."""
    src = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    names = src.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", score double, predicted int, spans array<struct<start:long,end:long,probability:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches):
        score = model.scorer()
        for batch in batches:
            for block in T.blocks(batch.column(len(names)), limit=chunk):
                part = batch.slice(block.row, len(block))
                got, spans = score(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got), pa.array((got >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=[*names, "score", "predicted", "spans"])
        del score
        T.give_back()

    return src.mapInArrow(run, schema)
