"""Trained operators, the token files, HTML and the pipeline: brute force, round trips, held-out accuracy."""

import hashlib
import html.parser
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from test_text_ops import SPACED, awkward, brute_decontam, brute_jaccard, documents, empty, lower

import corpus_pipeline
from curvelake.llm import html_text, interpolation, langid, mixing, toxicity
from curvelake.llm import queries as Q
from curvelake.llm.tokens import Shard, read_token_shards, shard_starts, token_index, write_token_shards

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op3_language(spark, sf).where("held_out").join(documents(spark, sf).select("doc_id", "lang"), "doc_id")
    n, right = got.agg(F.count("*"), F.count(F.when(F.col("lang") == F.col("lang_pred"), 1))).first()
    assert n > 300 and right >= 0.97 * n


def test_language_awkward(spark, sf):
    model = langid.learn_languages(documents(spark, sf), F.lit(True))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "½ ²"), (5, "漢字"), (6, "the and of")], "doc_id long, text string").withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: r for r in langid.predict_language(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5].lang_pred in model.languages and got[6].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.learn_languages(empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.predict_language(docs, none).collect()} == {"und"}
    assert langid.predict_language(empty(spark), model).count() == 0


def test_language_tables(spark):
    """The tables that Spark counts are those of plain dictionaries, predictions those of plain loops; no word is left out."""
    rng = np.random.default_rng(0)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["tu", "re", "mi"], "cc": ["xo", "ka", "\u00fc"]}
    text = lambda lang: " ".join("".join(rng.choice(syllables[lang], int(rng.integers(1, 4)))) for _ in range(12))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.learn_languages(docs, F.lit(True))
    counts = Counter((lang, w) for _, t, lang in rows for w, c in langid.words_of(t).items() for _ in range(c))
    want = langid.LanguageModel.of_counts(counts)
    got.tables()
    want.tables()
    assert got.languages == want.languages == ["aa", "bb", "cc"] and got.totals == want.totals and set(got.rows_of[0]) == {w for _, w in counts}
    for k in range(6):
        assert set(got.rows_of[k]) == set(want.rows_of[k])
        assert all(np.allclose(got.logs[i], want.logs[want.rows_of[k][g]], atol=1e-6) for g, i in got.rows_of[k].items())

    def plain(t):
        sums = np.zeros(3)
        for w, c in langid.words_of(t).items():
            for k in range(0, -6, -1) if w in got.rows_of[0] else range(5, 0, -1):
                found = [got.logs[got.rows_of[k][g]] for g in langid.grams(w, k) if g in got.rows_of[k]]
                if found:
                    sums += c * np.mean(found, axis=0)
                    break
        p = np.exp(sums - sums.max())
        return got.languages[int(p.argmax())], float(p.max() / p.sum())

    predict = got.predictor()
    for t in ["kalo mimi", "zzxo tu", "\u00fcx", "kakaka tumi xoxo", "lomi"]:
        assert predict(t)[0] == plain(t)[0] and predict(t)[1] == pytest.approx(plain(t)[1], abs=1e-4)


def test_chain_against_enumeration():
    rng = np.random.default_rng(3)
    length = np.array([0, 1, 4, 2, 5])
    first = np.cumsum(length) - length
    emit, move = np.exp(rng.normal(size=12)), np.exp(rng.normal(size=(2, 2)))
    forward, backward = toxicity.chain_odds(emit, first, length, move)
    p = forward * backward / (1 + forward * backward)
    for f, n in zip(first, length, strict=True):
        total, marked = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = math.prod(emit[f + i] for i in range(n) if labels[i]) * math.prod(move[a, b] for a, b in zip(labels, labels[1:], strict=False))
            total += w
            marked += w * np.array(labels)
        assert np.allclose(p[f : f + n], marked / total)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.op6_toxicity(spark, sf).where("held_out").join(labels.where("toxic is not null"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("k")).collect()
    rate = {r.toxic: r.k / r.n for r in got}
    assert rate[1] >= 0.85 and rate[0] <= 0.01


def test_toxicity_awkward(spark):
    words = ["one two three four", "five six seven eight", "nine ten one five"]
    texts = [f"{words[i % 3]} v{i} u{i * 7} {'nastyword' if i % 2 else 'kindword'} x{i}" for i in range(200)]
    model = toxicity.learn_toxicity(texts, [i % 2 for i in range(200)])
    got, spans = model.scorer()(["", None, "so NASTYWORD here", "so kind here", "!!"])
    assert got[2] > 0.5 > got[3] and spans[2][0]["start"] == 3 and spans[2][0]["end"] == 12 and not spans[3]
    assert got[0] == got[1] == got[4] < 0.5
    rows = toxicity.score_toxicity(awkward(spark), model).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    plain = toxicity.fit_toxicity(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r.predicted for r in toxicity.score_toxicity(awkward(spark), plain).collect()} == {0}


def test_toxicity_sample(spark):
    """The sample is bounded by rows and by characters; texts of any length are in it."""
    docs = spark.createDataFrame([(i, "word " * (5000 if i % 3 else 30) + f"v{i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    tally = lambda **most: {r.label: (r.n, r.chars) for r in toxicity.training_rows(docs, labels, F.lit(True), **most).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    by_rows, by_chars = tally(most_rows=100), tally(most_rows=900, most_chars=1_000_000)
    assert all(70 < n < 130 and chars > 1_000_000 for n, chars in by_rows.values())
    assert all(500_000 < chars < 1_500_000 for _, chars in by_chars.values())
    assert sum(n for n, _ in tally().values()) == 900


def test_toxicity_fit_on_executors(spark):
    """The fit in a task gives the weights that the fit gives here, also for texts longer than a piece."""
    texts = [f"{'one two three four ' * (200 if i % 9 == 0 else 1)} v{i} {'nastyword' if i % 2 else 'kindword'} x{i} y{i * 3}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    got, want = toxicity.fit_toxicity(docs, labels, F.lit(True)), toxicity.learn_toxicity(texts, [i % 2 for i in range(120)])
    assert got.weights == want.weights and got.bias == want.bias and (got.move == want.move).all() and got.head == want.head and got.weights["wnastyword"] > 0
    first, length = toxicity.cut_pieces(np.array([0, 5, 1, 8]), 4)
    assert first.tolist() == [0, 4, 5, 6, 10] and length.tolist() == [4, 1, 1, 4, 4]


def test_toxicity_offsets(spark):
    """Offsets are those of the text as it came, also behind a letter whose lower case is longer."""
    texts = [f"one two v{i} {'nastyword' if i % 2 else 'kindword'} x{i}" for i in range(120)]
    model = toxicity.learn_toxicity(texts, [i % 2 for i in range(120)])
    text = "\u0130\u0130 \u0130zmir NASTYWORD end"
    _, spans = model.scorer()([text])
    assert [text[s["start"] : s["end"]] for s in spans[0]] == ["NASTYWORD"]


def tokens_of(text):
    return [*SPACED.findall(lower(text)), None]


def fold(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_interpolation_base(spark, sf, which):
    docs = documents(spark, sf) if which == "table" else awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    counts = Counter(t for r in rows if r.doc_id is None or fold(r.doc_id, 5) != 1 for t in tokens_of(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id is None, r.doc_id, len(tokens_of(r.text)), sum(counts[t] > 0 for t in tokens_of(r.text)), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens_of(r.text)), 5)) for r in rows if r.doc_id is not None)
    out = interpolation.interpolated_scores(docs, Q.fold(5) != 1, Q.fold(50) % 10 == 2).collect()
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out if r.doc_id is not None)
    assert got == want and len(out) == len(rows) and all(r.score <= 0 for r in out)
    if which == "table":
        assert np.mean([r.score for r in out]) > np.mean([r.base_score for r in out])
    assert interpolation.interpolated_scores(empty(spark), F.lit(True), F.lit(False)).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolation_brute(spark, order):
    """Scores with weights learned from cells equal those of plain dictionaries, up to the cells' rounding of the weights."""
    texts = ["a b c a b", "a b d", "c a b c", "b a", "", "a b c d e f a b", "z a b", "c c c"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train, held = [i % 4 != 1 for i in range(len(texts))], [i % 4 == 2 for i in range(len(texts))]
    got = {r.doc_id: r.score for r in interpolation.interpolated_scores(docs, F.col("doc_id") % 4 != 1, F.col("doc_id") % 4 == 2, order=order).collect()}

    def padded(t):
        return ["<b>"] * (order - 1) + tokens_of(t)

    def grams(pick):
        out = Counter()
        for t, use in zip(texts, pick, strict=True):
            if use:
                seq = padded(t)
                for i in range(order - 1, len(seq)):
                    for n in range(1, order + 1):
                        out[tuple(seq[i - n + 1 : i + 1])] += 1
                        out["context", tuple(seq[i - n + 1 : i])] += 1
        return out

    full, kept = grams(train), grams([a and not b for a, b in zip(train, held, strict=True)])

    def parts(c, seq, i, types):
        p, level, count = [1 / (types + 1)], 0, 0
        for n in range(1, order + 1):
            x = c["context", tuple(seq[i - n + 1 : i])]
            p.append(c[tuple(seq[i - n + 1 : i + 1])] / x if x else 0.0)
            if n > 1 and x:
                level, count = n - 1, x
        return p, level * interpolation._BUCKETS + (int(math.log2(count)) if level else 0)

    types = lambda c: sum(1 for k in c if k[0] != "context" and len(k) == 1)
    cells, counts = [], []
    for t, use in zip(texts, held, strict=True):
        for i in range(order - 1, len(padded(t)) if use else 0):
            p, b = parts(kept, padded(t), i, types(kept))
            cell = b
            for x in p[:0:-1]:
                cell = cell * (interpolation._STEPS + 1) + (min(round(-2 * math.log2(x)), interpolation._STEPS - 1) if x > 0 else interpolation._STEPS)
            cells.append(cell)
            counts.append(1.0)
    weights = interpolation.learn_weights(np.array(cells), np.array(counts), order, types(kept))
    for k, t in enumerate(texts):
        score = 0.0
        for i in range(order - 1, len(padded(t))):
            p, b = parts(full, padded(t), i, types(full))
            score += math.log10(float(weights[b] @ np.array(p)))
        assert got[k] == pytest.approx(score, abs=1e-6)


def test_interpolation_rare_words():
    """On 5e9 tokens, words of few occurrences teach the weights by their own estimates, not by clipped ones."""
    tokens, types, count = 5e9, 1e7, np.array([0, 1, 5, 40, 400, 1e5, 1e7])
    n = np.array([900.0, 300, 200, 200, 300, 400, 2000])
    p = count / tokens
    steps = interpolation.grid_steps(tokens)
    cells = interpolation.code_cells(np.zeros(len(p), dtype=np.int64), p[None], steps)
    got = interpolation.learn_weights(cells, n, 1, types, grid=steps)[0]
    w = np.array([0.5, 0.5])
    for _ in range(60):
        share = w * np.stack([np.full(len(p), 1 / (types + 1)), p], axis=1)
        w = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
    assert steps > 2 * math.log2(tokens) and np.abs(got - w).max() < 0.01
    assert interpolation.grid_steps(1000.0) == interpolation._STEPS


def test_token_round_trip(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    for docs in (documents(spark, sf), awkward(spark)):
        want = {}
        for r in docs.select("doc_id", "text").collect():
            ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
            want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        got = token_index(docs, BPE, 2, shard_bytes=1 << 16).orderBy("start").collect()
        at, last = 0, None
        for r in got:
            assert r.start == at and (last is None or r.doc_id >= last) and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
            at, last = at + r.n_tokens, r.doc_id
        assert len(got) == docs.count()
    assert token_index(empty(spark), BPE, 2).count() == 0


def test_token_frames(spark, sf, tmp_path):
    path = f"file://{tmp_path}/shards"
    write_token_shards(documents(spark, sf), path, BPE, 2, shard_bytes=1 << 17)
    files = sorted(p for p in (tmp_path / "shards").iterdir() if p.name.startswith("part") and p.stat().st_size)
    assert len(files) > 1
    raw = files[0].read_bytes()
    shard = Shard(raw)
    assert raw[-4:] == b"\xb1\xea\x92\x8f" and int.from_bytes(raw[-9:-5], "little") == len(shard)  # the seek table's footer ends the file
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(shard.ids(i).tobytes() for i in range(len(shard)))
    broken = bytearray(raw)
    broken[int(shard.offset[1]) + int(shard.frames["packed"][1]) // 2] ^= 1
    Shard(broken).ids(0)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        Shard(broken).ids(1)
    some = {3, 77}
    assert {r.doc_id for r in read_token_shards(spark, path, some).collect()} == some


def test_token_shard_starts(spark):
    """Sums over groups of shards, with gaps between shard numbers."""
    rows = [(s, n) for s in (0, 1, 3, 4, 5, 9, 10, 20, 21) for n in (s + 1, 2)]
    read = spark.createDataFrame(rows, "shard long, n_tokens long")
    got = {r.shard: r.base for r in shard_starts(read, group=4).collect()}
    assert got == {s: sum(n for t, n in rows if t < s) for s, _ in rows}


def test_token_equal_rows(spark, tmp_path):
    """Equal rows are cut between shards, and each is there once."""
    docs = spark.createDataFrame([(7, "one two three")] * 400 + [(8, "x")], "doc_id long, text string").repartition(4)
    got = token_index(docs, BPE, 2, path=f"file://{tmp_path}/equal", shard_bytes=64)
    assert got.count() == 401 and got.select("shard").distinct().count() > 2
    assert [r.start for r in got.orderBy("start").collect()] == list(range(0, 1604, 4))[:401]


PAGES = [
    ("<p>One<p>Two <b>bold</b>\n text", "One\n\nTwo bold text"), ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"), ("<table><tr><th>Name<th>Age<tr><td>Jo<td>7<tr><td>Maria<td>12</table>", "Name  | Age\nJo    | 7\nMaria | 12"),
    ("<div hidden>no</div><div style='display:none'>no</div><span>yes</span><script>var t='</p>';</script>", "yes"), ("<style>.x{display:none}</style><p class='a x'>no</p><p>yes</p>", "yes"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<pre>  a\n    b</pre>c", "  a\n    b\n\nc"),
    ("x &lt;b&gt; &amp; &eacute; <!-- no --> y", "x <b> & é y"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"), ("<title>no</title><h1>Yes", "Yes"), ("", ""), ("<p", "<p"), ("</div></p>x", "x"),
    ("<div>" * 3000 + "deep", "deep"), ("<select><option>a<option>b</select>", "a\nb"), ("<table><tr><td>a</table>b", "a\n\nb"),
]


def test_html(spark):
    for source, want in PAGES:
        assert html_text.render(source) == want, source[:80]
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, PAGES[0][0])], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df).collect() if r.text is not None)
    assert got == [(2, "", 0), (2, "", 0), (3, PAGES[0][1], len(PAGES[0][1]))]
    assert html_text.extract_text(df.where("false")).count() == 0


def test_html_style_rules_and_drawings():
    nav = '<div class="nav">menu</div>'
    page = lambda css, body=nav, media="": html_text.render(f"<style{media}>{css}</style>{body}")
    assert page("@media print{.nav{display:none}}") == page("@media (max-width:9px){.nav{display:none}}") == page(".nav{display:none}", media=' media="print"') == "menu"
    assert page(".nav{display:none} .nav{display:block}") == page("div{display:none} .nav{display:block}") == "menu"
    assert page("@media screen{.nav{display:none}}") == page("/* } */ .nav{color:red;display:none}") == page(".nav{display:none} div{display:block}") == page(".nav{display:none!important} .nav{display:block}") == ""
    assert page("@media print{.x{display:none} .y{color:red}} .nav{display:none}") == ""
    assert html_text.render("<p>a <svg><title>t</title><path d='x'/><defs><text>no</text></defs><text>label</text><g><text>two</text></g></svg> b</p>") == "a label two b"
    assert html_text.render("<math><mfrac><mn>1</mn><mn>2</mn></mfrac><mo>=</mo><mi>x</mi></math> <map><area><a>link</a></map>") == "1 2=x link"


def test_html_hostile_pages():
    """Broken numbers, deep nesting and markup that never closes: right text, in time that follows the length."""
    render = html_text.render
    assert render('<ol start="--5"><li>a</ol><ol start="\u00b2"><li>b</ol><ol start="-3"><li>c<li>d</ol>') == "1. a\n\n1. b\n\n-3. c\n-2. d"
    assert render(f'<table><tr><td colspan="\u00b2">a<td colspan="{"9" * 5000}">b<td>c</table>') == "a | b | c"
    for hidden in ("<div hidden>" + "<div>" * 300 + "LEAK", "<div>" * 300 + "<p hidden><b>LEAK</b></p>", "<p hidden>" + "<b>" * 3000 + "LEAK"):
        assert render(hidden + "</b>" * 3000 + "</div>" * 600 + "<p>end") == "end"
    assert render("<div hidden>" + "<div>" * 210 + "no" + "</div>" * 211 + "yes") == "yes"
    began = time.process_time()
    n = 100_000
    pages = ["<a" * n, '<a b="' * n, "<a b='\">" * n, "<a b='>'" * n, "<!--" * n, "</" * n, "< " * n, "<div>" * n + "x", "<p><button>" + "<div>" * n + "x", "<ul><li>" * n + "x", "<table><tr><td>" * n + "x", "<svg><text>" * n + "x", "<svg><foreignObject>" * n + "x", "<b>" * n + "x" + "</i>" * n,
             "<blockquote>" * 2000 + "x", "<pre>" * n + "x", "<details open>" * n + "x", "<style>" + '"' * n, "<script>" * n, "&amp" * n, "<a =" * n + ">x", "<table>" + "<tr><td colspan=1000>a" * 3000 + "</table>"]
    texts = [render(p) for p in pages]
    assert time.process_time() - began < 60
    assert texts[0] == pages[0] and all(t.strip().endswith("x") for p, t in zip(pages, texts, strict=True) if p.endswith("x") and "pre" not in p)


def test_html_wide_cells():
    """A cell beyond the limit doesn't unalign the other rows; tables in cells keep all their text in order."""
    long = "w" * 500
    assert html_text.render(f"<table><tr><td>a<td>1<tr><td>{long}<td>2<tr><td>bcd<td>3</table>") == f"a   | 1\n{long} | 2\nbcd | 3"
    assert html_text.render("<table><tr><td>a<table><tr><td>b<td>c<tr><td>d<td>e</table>f<td>g</table>") == "a b | c d | e f | g"


class _Visible(html.parser.HTMLParser):
    """Words a reader sees, by another parser that knows nothing of layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style")
        self.parts.append(" " if tag in html_text.BLOCK or tag == "br" else "")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style")
        self.parts.append(" " if tag in html_text.BLOCK else "")

    def handle_data(self, data):
        self.parts.append("" if self.off else data)


def test_html_visible_words_of_all_pages(spark, sf):
    """Every visible word of every page comes out once and in order, nothing else but list markers does."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.select("page_id", "html").collect():
        other = _Visible()
        other.feed(r.html)
        other.close()
        words = "".join(other.parts).split()
        assert [w for line in got[r.page_id].split("\n") for w in re.sub(r"^ *- ", "", line).split()] == words
    assert len(got) == pages.count()


def test_html_random_trees():
    """Random nesting of blocks, lists and inline tags, hidden parts and stray end tags, against lines written from the plan."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        source, lines = "", []
        for i in range(int(rng.integers(1, 8))):
            kind, word = int(rng.integers(0, 5)), f"w{i}"
            if kind == 0:
                source, lines = source + f"<p>{word} <b>x</b>", [*lines, "", f"{word} x", ""]
            elif kind == 1:
                source, lines = source + f"<ul><li>{word}<li>y</ul>", [*lines, "", f"- {word}", "- y", ""]
            elif kind == 2:
                source, lines = source + f"<div>{word}</i></div>", [*lines, word]
            elif kind == 3:
                source += f"<div hidden>{word}</div><p style='display:none'>{word}</p>"
            else:
                source, lines = source + f"<table><tr><td>{word}<td>z</table>", [*lines, "", f"{word} | z", ""]
        want = re.sub(r"\n\n+", "\n\n", "\n".join(lines)).strip("\n")
        assert html_text.render(source) == want, source


def test_mixing_awkward(spark):
    docs = awkward(spark).withColumns({c: F.lit("clash") for c in ("mix_copy", "mix_source", "mix_steps", "mix_first", "rate", "name", "doc", "own_source")})
    assert [c for c in mixing.mix_sources(docs, {"s": 1.0}).columns if c not in docs.columns] == ["mix_copies", "mix_key"]
    assert mixing.mix_sources(docs, {"other": 1.0}, size=600.0, default_weight=1.0).where("mix_source = 'clash' and rate = 'clash'").count() > 300
    out = mixing.mix_sources(docs, {"s": 1.0}, size=600.0)
    n = out.count()
    assert 300 < n < 1000 and mixing.mix_sources(docs, {"other": 1.0}).count() == 0 and mixing.mix_sources(docs.where("false"), {"s": 1.0}).count() == 0
    per = {(r.doc_id, r.text): r["count"] for r in out.where("doc_id is not null").groupBy("doc_id", "text", "mix_copies").count().collect()}
    assert per[6, awkward(spark).where("doc_id = 6").first().text] % 2 == 0
    u, rate = 0.7312, 2.5
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while u > c:
        k += 1
        p *= rate / k
        c += p
    assert spark.range(1).select(mixing.poisson_inverse(F.lit(u), mixing.poisson_steps(F.lit(rate), 100)).alias("k")).first().k == k
    missing = mixing.mix_sources(docs.withColumn("source", F.lit(None).cast("string")), {None: 1.0}, size=600.0)
    assert missing.count() == n


def test_mixing_large_rates(spark):
    """Sources of a few rows among many: means of 4,000 and of 250 copies, drawn by the same inversion."""
    docs = spark.range(8100).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "one").when(F.col("id") <= 16, "few").otherwise("rest").alias("source"))
    rate = {r.source: r.rate for r in mixing.source_rates(docs, {"one": 1.0, "few": 1.0}, 0.0, 8000.0, "source").collect()}
    assert rate["one"] == 4000 and rate["few"] == 250
    got = {r.doc_id: r for r in mixing.mix_sources(docs, {"one": 1.0, "few": 1.0}, size=8000.0).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("mix_copies").alias("k")).collect()}
    for d in range(17):
        u, lam = (int(hashlib.md5(f"7|{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, rate["one" if d == 0 else "few"]
        k, c = 0, math.exp(-lam)
        while u > c:
            k += 1
            c += math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1))
        assert got[d].n == got[d].k == k
    first, steps = mixing.far_steps(1e7)
    at = np.arange(first, first + len(steps))
    p = np.diff(steps, prepend=0.0)
    assert abs((at * p).sum() / 1e7 - 1) < 1e-9 and abs(((at - 1e7) ** 2 * p).sum() / 1e7 - 1) < 1e-6


def test_pipeline_stages(spark, sf, tmp_path):
    docs = awkward(spark).select(*corpus_pipeline.COLUMNS).withColumn("source", F.lit("src1"))
    base = spark.read.parquet(f"{sf}/documents.parquet")
    for start in (base.unionByName(docs), docs, docs.where("false")):
        kept = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{start.count()}-{k}")
            stage(spark, kept, sf).write.parquet(path)
            after = spark.read.parquet(path)
            if k < 4:
                assert after.columns == corpus_pipeline.COLUMNS
            if name in ("toxicity", "near_duplicates", "decontamination"):
                assert after.exceptAll(kept.select(*corpus_pipeline.COLUMNS)).count() == 0
            kept = after
    assert corpus_pipeline.run(spark, sf).count() > 50


def poisson_copies(doc_id, rate, seed=Q.MIX_SEED):
    u = (int(hashlib.md5(f"{seed}|{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, c = 0, math.exp(-rate)
    while u > c:
        k += 1
        c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
    return k


def test_pipeline_brute(spark, sf, tmp_path):
    """Each stage's rows on the smallest tables against plain loops over what its predecessor kept."""
    from tokenizers import Tokenizer

    docs = documents(spark, sf)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "tokens":
            plain = Tokenizer.from_file(BPE)
            plain.encode_special_tokens = True
            want = []
            for d, text, _ in before:
                ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
                want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            assert sorted(tuple(r) for r in docs.select("doc_id", "n_tokens", "ids_crc32").collect()) == sorted(want)
            continue
        after = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        if name == "toxicity":
            model = toxicity.fit_toxicity(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), Q.fold(5) != 0)
            score = model.scorer()
            want = [r for r in before if score([r[1]])[0][0] < 0.5]
        elif name == "near_duplicates":
            classes = {d: c for d, c, _ in brute_jaccard([(d, t) for d, t, _ in before])}
            assert len({classes[d] for d, _, _ in after}) == len(after) == len(set(classes.values())) and set(after) <= set(before)
            continue
        elif name == "decontamination":
            dirty = {r[0] for r in brute_decontam([(d, t) for d, t, _ in before], bench) if r[-1]}
            want = [r for r in before if r[0] not in dirty]
        else:
            n = Counter(r[2] for r in before)
            weight = {x: Q.MIX_WEIGHTS.get(x, Q.MIX_DEFAULT) for x in n}
            rate = {x: weight[x] / sum(weight.values()) * len(before) / n[x] for x in n}
            want = [r for r in before for _ in range(poisson_copies(r[0], rate[r[2]]))]
        assert sorted(after, key=repr) == sorted(want, key=repr), name


def test_html_visibility_is_inherited():
    """Random trees of elements that hide, show, inherit or aren't displayed, against a recursion over the plan."""
    render = html_text.render
    assert render("<div style='visibility:hidden'>no<p>no<span style='visibility:visible'>yes</span><b style='visibility:inherit'>no</b></p></div>end") == "yes\n\nend"
    assert render("<style>.h{visibility:hidden} .s{visibility:visible}</style><table class=h><caption>no</caption><tr><td>no<td class=s>b<tr class=s><td>c<td>d</table>") == "  | b\nc | d"
    assert render("<style>.h{visibility:hidden} .s{visibility:visible}</style><ol><li class=h>no<b class=s>y</b><li>z</ol><pre class=h>no <i class=s>yes</i></pre>") == "   y\n2. z\n\nyes"
    rng = random.Random(11)
    ways = [("", None), (" style='visibility:hidden'", True), (" style='visibility:visible'", False), (" style='visibility:inherit'", None), (" class=h", True), (" class=s", False), (" hidden", "out")]

    def tree(depth, hidden, out):
        source, seen = "", []
        for _ in range(rng.randrange(1, 4)):
            if depth and rng.random() < 0.7:
                how, own = rng.choice(ways)
                tag = rng.choice(["div", "span", "b", "section"])
                inner, words = tree(depth - 1, hidden if own in (None, "out") else own, out or own == "out")
                source, seen = source + f"<{tag}{how}>{inner}</{tag}>", seen + words
            else:
                word = f"w{rng.randrange(10**6)}"
                source, seen = source + f" {word} ", seen + ([] if hidden or out else [word])
        return source, seen

    for _ in range(300):
        source, seen = tree(5, False, False)
        assert render(f"<style>.h{{visibility:hidden}}.s{{visibility:visible}}</style>{source}").split() == seen, source


def test_html_rules_with_one_selector_are_folded():
    styles = ["*{display:none}" * 50 + "*{display:block}" + ".a.b{display:none} .b.a{display:block}"]
    rules = html_text.hidden_selectors(styles)
    assert sum(map(len, rules.values())) == 2
    assert html_text.render(f"<style>{styles[0]}</style><p class='a b'>x</p>") == "x"
    assert html_text.render("<style>p{display:none!important}p{display:block}#i.c{display:none}b.c{display:block}</style><p>no</p><b id=i class=c>no</b><b class=c>yes</b>") == "yes"
    spread = html_text.hidden_selectors(["".join(f".b{i}.a{{display:none}}" for i in range(100))])
    assert max(map(len, spread.values())) == 1  # under the rarer part


def test_html_padding_is_bounded():
    for page in ("<blockquote>x" * 2000, "<ul><li>x" * 2000, "<table><tr>" + ("<td>" + "w" * 200) * 300 + "<tr><td colspan=1000>a<td>b" * 500):
        assert len(html_text.render(page)) < 6 * len(page)
    deep = html_text.render("<blockquote>" * 100 + "x").split("\n")
    assert deep == [" " * html_text.DEEPEST + "x"]
    assert html_text.render("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>") == "ab    | c\nd | e | f"
    assert html_text.render("<table><tr><td><ul><li>a<li>b</ul><td>c<tr><td>d<td>e</table>") == "- a - b | c\nd       | e"


def brute_toxicity(texts, labels, piece, rounds, chance=1e-5, purity=0.85):
    """The field's learning by enumeration of all label sequences: marks, gradients, steps and each text's top and mass."""
    words = [toxicity.tokens(t) for t in texts]
    feats = {w: toxicity.features(w) for ws in words for w in ws}
    own = [{f for w in ws for f in feats[w]} for ws in words]
    n, toxic = Counter(f for o in own for f in o), Counter(f for o, y in zip(own, labels, strict=True) if y for f in o)
    q = sum(labels) / len(labels)
    tail = lambda k, m: sum(math.comb(m, j) * q**j * (1 - q) ** (m - j) for j in range(k, m + 1))
    marks = {f for f in n if toxic[f] >= 3 and toxic[f] >= purity * n[f] and tail(toxic[f], n[f]) < chance}
    pieces = [(ws[k : k + piece], [int(y and not marks.isdisjoint(feats[w])) for w in ws[k : k + piece]]) for ws, y in zip(words, labels, strict=True) for k in range(0, len(ws), piece)]
    w, trans, moves = dict.fromkeys(n, 0.0), dict.fromkeys(itertools.product((0, 1), repeat=2), 0.0), lambda z: zip(z, z[1:], strict=False)
    bias = math.log((sum(map(sum, (z for _, z in pieces))) + 1) / sum(len(ws) for ws, _ in pieces))

    def marginals(ws):
        e = [bias + sum(w.get(f, 0.0) for f in feats[x]) for x in ws]
        paths = {z: math.exp(sum(a for a, b in zip(e, z, strict=True) if b) + sum(trans[m] for m in moves(z))) for z in itertools.product((0, 1), repeat=len(ws))}
        total = sum(paths.values())
        return {z: v / total for z, v in paths.items()}

    square = Counter()
    for _ in range(rounds):
        g = {("w", f): -0.05 * w[f] for f in w} | {("t", m): -0.05 * trans[m] for m in trans} | {"bias": 0.0}
        for ws, gold in pieces:
            for z, p in [(tuple(gold), 1.0), *((z, -p) for z, p in marginals(ws).items())]:
                for x, b in zip(ws, z, strict=True):
                    if b:
                        g["bias"] += p
                        for f in feats[x]:
                            g["w", f] += p
                for m in moves(z):
                    g["t", m] += p
        for k in g:
            square[k] += g[k] ** 2
        step = lambda k, rate: rate * g[k] / math.sqrt(square[k] + 1e-8)  # noqa: B023, E731
        w = {f: v + step(("w", f), 0.7) for f, v in w.items()}
        trans = {m: v + step(("t", m), 0.3) for m, v in trans.items()}
        bias += step("bias", 0.7)
    w = {f: v for f, v in w.items() if abs(v) > 1e-3}
    p = [[sum(v for z, v in found.items() if z[t]) for t in range(len(ws))] for ws in words for found in [marginals(ws)]]
    return marks, w, bias, trans, [(max(x, default=0.0), sum(v for v in x if v >= 0.5)) for x in p]


def test_toxicity_learning_by_enumeration():
    rng = random.Random(5)
    clean, bad = [f"word{chr(97 + k)}" for k in range(20)], ["vilex", "vilez", "nastq"]
    texts = [" ".join([*rng.sample(clean, 4), *([rng.choice(bad), rng.choice(bad)] if i % 3 == 0 else []), *rng.sample(clean, 2)]) for i in range(60)]
    labels = [int(i % 3 == 0 or i == 7) for i in range(60)]
    keep = toxicity.distinct_texts(texts)
    texts, labels = [texts[i] for i in keep], [labels[i] for i in keep]
    model = toxicity.learn_toxicity(texts, labels, piece=5, rounds=6)
    marks, w, bias, trans, totals = brute_toxicity(texts, labels, 5, 6)
    assert marks and set(model.weights) == set(w)
    assert model.weights == pytest.approx(w, abs=1e-8) and model.bias == pytest.approx(bias, abs=1e-8)
    assert np.log(model.move).reshape(-1).tolist() == pytest.approx([trans[m] for m in sorted(trans)], abs=1e-8)
    x = np.array([[1, top, math.log1p(mass)] for top, mass in totals])
    score = 1 / (1 + np.exp(-x @ np.array(model.head)))
    assert model.scorer()(texts)[0] == pytest.approx(score, abs=1e-8)
    assert x.T @ (np.array(labels) - score) == pytest.approx(0.05 * np.array(model.head), abs=1e-6)  # the ridge's optimum


def test_context_buckets_follow_the_tokens():
    assert interpolation.context_buckets(10) == interpolation._BUCKETS and interpolation.context_buckets(2.0**40) == 42
    counts = [np.array([1.0, 2.0**30, 2.0**36])] * 2
    found = interpolation._bucket(counts, interpolation.context_buckets(2.0**40))
    assert len(set(found.tolist())) == 3
