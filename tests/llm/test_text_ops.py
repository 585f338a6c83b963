"""Operators on words against brute force, on the smallest table and on rows made to be awkward."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from curvelake.llm import queries as Q
from curvelake.llm.decontam import decontaminate
from curvelake.llm.jaccard import jaccard_classes, least_matches
from curvelake.llm.licenses import PHRASES, TEMPLATES, license_scan
from curvelake.llm.repetition import repetition_quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def awkward(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Été ÉTÉ été MIT License; mit license"), (6, PHRASE), (6, PHRASE), (7, "x " + PHRASE.upper() + " y"), (None, PHRASE), (8, long), (9, long + " tail"),
        (10, "the Apache License and the GNU General Public License, version 3."), (11, "a b a b a b a b a b a b"), (12, "same line\nsame line\n\nsame line\n other"), (13, "alpha beta gamma delta"), (14, "   nbsp joined\x1fctl"),
        (15, "Released under the MIT License."), (16, "mit"), (17, "# $ % & | < > *"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("pos", F.lit("clash")).withColumn("w", F.lit(1)).withColumn("h", F.lit(2)).withColumn("row_key", F.lit(3)).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(0).cast("long"))


def empty(spark):
    return awkward(spark).where("false")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def brute_repetition(text):
    words = SPACED.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_repetition_counts(spark, sf, which):
    docs = documents(spark, sf) if which == "table" else awkward(spark)
    got = rows_of(repetition_quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((r.doc_id, *brute_repetition(r.text)) for r in docs.collect()), key=repr)
    bad = repetition_quality(docs).where("kept and base_failed").count()
    assert bad == 0


def brute_windows(text, size=10):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_decontam(docs, items):
    windows = {}
    for item, text in items:
        for w in brute_windows(text):
            windows.setdefault(w, set()).add(item)
    out = []
    for doc_id, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (own := windows.get(tuple(words[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= own
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc_id, len(words), len(hit), len([x for x in found if x is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLS5 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("small", [200_000, 0])
def test_decontamination_table(spark, sf, small):
    docs, bench = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = rows_of(decontaminate(docs, bench, small=small), *COLS5)
    assert got == brute_decontam([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("small", [200_000, 0])
def test_decontamination_awkward(spark, small):
    items = [(1, PHRASE), (2, "alpha beta"), (3, None), (4, ""), (5, "a b a b a b a b a b"), (6, PHRASE), (None, "the Apache"), (10, "w0x0 w1x1"), (7, "mit"), (2, "alpha beta"), (8, " ".join(f"w{i % 977}x{i}" for i in range(29_000, 29_015)))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("pos", F.lit(1))
    docs = awkward(spark)
    assert rows_of(decontaminate(docs, bench, small=small), *COLS5) == brute_decontam([(r.doc_id, r.text) for r in docs.collect()], items)
    assert not decontaminate(docs, bench.where("false"), small=small).where("contaminated").count()
    assert decontaminate(docs, bench.where("false"), small=small).count() == docs.count()
    assert decontaminate(empty(spark), bench, small=small).count() == 0


def brute_license(text):
    words = WORD.findall(lower(text))
    hits = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_license_base(spark, sf, which):
    docs = documents(spark, "/root/testdata/sf0.01") if which == "table" else awkward(spark)
    out = license_scan(docs)
    got = rows_of(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((r.doc_id, *brute_license(r.text)) for r in docs.collect()), key=repr)
    for r in out.collect():
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_votes(spark):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software".split()
    cut = mit[:40] + ["inserted", "words"] + mit[40:90] + mit[92:]
    rows = [(1, "x y " + " ".join(cut) + " z"), (2, " ".join(mit[:20])), (3, "Licensed under CC BY-NC 4.0."), (4, " ".join(mit[30:] + mit[:30][::-1])), (3, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].spans[0]["first"] == 2 and got[1].spans[0]["last"] == len(cut) + 1
    assert got[2].labels == "" and got[3].labels == "cc-by-nc" and got[4].labels == "mit" and got[3].score == 1.0
    assert license_scan(empty(spark)).count() == 0


def brute_scan(text, k=3, slack=4, coverage=0.6, density=0.5):
    """Labels, score and spans by plain loops."""
    words = WORD.findall(lower(text))
    n, places, first, last, base = brute_license(text)
    spans = []
    for label, template in TEMPLATES:
        cut = WORD.findall(lower(template))
        size = len(cut) - k + 1
        diagonals = {}
        for pos in range(len(words) - k + 1):
            for tpos in range(size):
                if words[pos : pos + k] == cut[tpos : tpos + k]:
                    diagonals.setdefault(pos - tpos, []).append(pos)
        runs, before = [], None
        for d in sorted(diagonals):
            lo = diagonals[d][0]
            joined = before is not None and d - before[0] <= slack and (lo - before[1]) * ((lo - d) - (before[1] - before[0])) > 0
            if not joined:
                runs.append([])
            runs[-1] += [(pos, pos - d) for pos in diagonals[d]]
            before = d, lo
        for run in runs:
            votes, lo, hi = len({t for _, t in run}), min(p for p, _ in run), max(p for p, _ in run)
            if votes >= coverage * size and votes >= density * (hi - lo + 1):
                spans.append((label, lo, hi + k - 1, round(votes / size, 9)))
    labels = {x for x in base.split(",") if x} | {s[0] for s in spans}
    score = 1.0 if places else max((s[3] for s in spans), default=0.0)
    return ",".join(sorted(labels)), round(score, 9), sorted(spans)


@pytest.mark.parametrize("which", ["table", "awkward", "repeats"])
def test_license_scan_brute(spark, sf, which):
    """The method's labels, score and spans on the whole smallest table, awkward rows, and repeated, cut and moved passages."""
    if which == "repeats":
        mit, cc = TEMPLATES[1][1], "Licensed under CC BY-NC 4.0."
        halves = mit.split()[:45], mit.split()[45:]
        texts = ["licensed under cc by licensed under cc by", "licensed under cc by " * 9, cc * 3, f"{mit} {mit} x {mit}", " ".join(halves[1] + halves[0]), " ".join(halves[0] + ["a", "b", "c"] + halves[1]), " ".join(halves[0] + halves[1][3:]),
                 " ".join(w for i, w in enumerate(mit.split()) if i % 9), " ".join(w for i, w in enumerate(mit.split()) if i % 3), mit[: len(mit) // 2], f"{cc} and {TEMPLATES[12][1]} {TEMPLATES[13][1]}"]
        docs = spark.createDataFrame(list(enumerate([*texts, texts[0], texts[3]])), "doc_id long, text string")
    else:
        docs = documents(spark, sf) if which == "table" else awkward(spark)
    got = sorted(((r.doc_id, r.labels, round(r.score, 9), sorted((s["label"], s["first"], s["last"], round(s["coverage"], 9)) for s in r.spans or [])) for r in license_scan(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *brute_scan(r.text)) for r in docs.select("doc_id", "text").collect()), key=repr)
    if which == "repeats":
        assert got[0][1] == "" and {g[0]: g[1] for g in got}[5] == "mit"


def shingle_set(text, n=5):
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_jaccard(docs):
    sets = [shingle_set(t) for _, t in docs]
    n = len(docs)
    links, up = [set() for _ in range(n)], list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        root = find(i)
        ids = [docs[k][0] for k in range(n) if find(k) == root and docs[k][0] is not None]
        least[root] = min(ids, default=None)
    return sorted(((docs[i][0], least[find(i)], len(links[i])) for i in range(n)), key=repr)


@pytest.mark.parametrize("which", ["table", "awkward", "edits"])
def test_jaccard_links(spark, sf, which):
    if which == "table":
        docs = documents(spark, sf)
    elif which == "awkward":
        docs = awkward(spark)
    else:  # a family of near copies around the threshold, in blocks of 8
        base = [f"t{i}" for i in range(120)]
        texts = [base[:k] + [f"n{k}"] + base[k:] for k in range(5, 115, 4)] + [base[: 120 - k] for k in range(0, 40, 3)] + [base[k:] + base[:k] for k in range(0, 60, 7)]
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = jaccard_classes(docs, block=8, members=5)
    assert rows_of(got, "doc_id", "class_id", "n_links") == brute_jaccard([(r.doc_id, r.text) for r in docs.collect()])
    firsts = got.where("is_first").groupBy("class_id").agg(F.countDistinct("row_key").alias("n")).where("class_id is not null and n <> 1").count()
    assert firsts == 0
    assert jaccard_classes(empty(spark)).count() == 0


def test_jaccard_boilerplate(spark, monkeypatch):
    """Texts that share a long passage but are no near copies don't meet in one group; pairs of near copies among them do."""
    passage = [f"b{i}" for i in range(200)]
    texts = [passage + [f"d{k}x{i}" for i in range(130)] for k in range(150)]
    texts += [t[:-6] + [f"new{k}"] for k, t in enumerate(texts[:40])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    groups = []
    from curvelake.llm import jaccard

    components = jaccard.connected_components
    monkeypatch.setattr(jaccard, "connected_components", lambda edges, scratch, name: (lambda out: (groups.append(out.groupBy("component").count().agg(F.max("count")).first()[0]), out)[1])(components(edges, scratch, name)))
    got = jaccard_classes(docs, members=32)
    assert rows_of(got, "doc_id", "class_id", "n_links") == brute_jaccard([(r.doc_id, r.text) for r in docs.collect()])
    assert groups[0] <= 4  # candidates' groups


def test_pruning_bound():
    least = least_matches(0.8, 1e-7, [16, 32, 128])
    assert least == sorted(least) and 0 < least[0] < 13 and least[2] < 103


def test_mixing_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(Q.oracle_sql()["op1_poisson_mix"]).fetchall()
    got = Q.op1_poisson_mix(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "source", "mix_copy", "mix_copies", "mix_key", "text_chars").collect()), key=repr) == sorted(want, key=repr)
