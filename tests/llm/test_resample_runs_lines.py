"""Importance resampling, periodic runs and line removal: whole queries and awkward tables against plain loops."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_text_ops import SPACED, WORD, awkward, documents, empty, lower

from curvelake.llm import line_dedup, resample, runs
from curvelake.llm import queries as Q
from curvelake.llm import text as T
from curvelake.llm.scratch import Scratch


def brute_resample(docs, target, percent, min_words, n_max, n_buckets, seed):
    def buckets(text):
        w = re.findall(WORD, lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]

    s, t, found = [0] * n_buckets, [0] * n_buckets, [buckets(text) for _, text in docs]
    for counts, texts in ((s, [b for _, b in found]), (t, [buckets(text)[1] for text in target])):
        for b in texts:
            for x in b:
                counts[x] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + n_buckets) / ((s[b] + 1) * (sum(t) + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for (i, text), (n_words, b) in zip(docs, found, strict=True):
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n_words, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), text])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(([*r[:5], drawn.get(id(r))] for r in rows), key=str)


def test_resample_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in Q.op11_importance_resample(spark, sf).collect()), key=str)
    want = brute_resample(docs, target, 10, 20, 1, 10_000, 2024)
    assert got == sorted(([r[0], *r[2:]] for r in want), key=str) and sum(r[4] is not None for r in got) > 5


def test_resample_awkward(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).select("doc_id", "text").collect()] + [(70 + k, f"One two three {'four ' * k}five.") for k in range(30)] + [(None, "one two three")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, rank long").repartition(3)
    target = spark.createDataFrame([("three four",), (None,), ("",), ("five",)], "text string")
    for n_max, percent in ((1, 100), (3, 37)):
        found = resample.importance_resample(docs, target, percent, 2, n_max, 97, 5).collect()
        got = sorted(([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in found), key=str)
        want = brute_resample(rows, ["three four", None, "", "five"], percent, 2, n_max, 97, 5)
        # rows of one id and equal score may have changed places
        assert [r[:5] for r in got] == [r[:5] for r in want] and sorted(str(r[5]) for r in got) == sorted(str(r[5]) for r in want)
    assert resample.importance_resample(empty(spark), target).count() == 0
    assert {r["rank"] for r in resample.importance_resample(docs, empty(spark), percent=0).collect()} == {None}


def test_prefix_crc():
    """Any span's CRC from two registers, at row ends and across them."""
    data = np.random.default_rng(3).integers(0, 256, 3000).astype(np.uint8)
    prefixes = resample.Prefixes(data)
    spans = [(0, 0), (0, 3000), (255, 256), (256, 512), (1, 2999), (3000, 3000), *(sorted(p) for p in np.random.default_rng(4).integers(0, 3001, (300, 2)).tolist())]
    start, end = np.array(spans).T
    assert prefixes.crc32(start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]
    assert resample.Prefixes(data[:0]).crc32(np.array([0]), np.array([0])).tolist() == [0]


def brute_runs(w, min_words, exponent):
    """Every period by itself: stretches of words equal to those q words on; stretches of a shorter period don't count."""
    found, n = [], len(w)
    codes = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // exponent + 1):
        equal = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j + q - i >= max(min_words, exponent * q) and not any(np.array_equal(codes[i : j + q - r], codes[i + r : j + q]) for r in range(1, q)):
                found.append((i, j + q - i, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(text, min_words=6, exponent=4):
    w = re.findall(SPACED, text or "")
    found = brute_runs(w, min_words, exponent)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for i, x in enumerate(w) if i not in gone))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_runs_query(spark, sf):
    docs = documents(spark, sf)
    planted = Q.with_repetition(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in planted.collect():
        h, w = zlib.crc32(str(r.doc_id).encode()), re.findall(SPACED, texts[r.doc_id] or "")
        if h % 10 or not w:
            assert r.text == texts[r.doc_id]
        else:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert r.text == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))
    want = {r.doc_id: brute_row(r.text) for r in planted.collect()}
    got = {r.doc_id: r for r in Q.op12_periodic_runs(spark, sf).collect() if r.doc_id in want}
    assert len(got) == len(want) and sum(x[0] > 0 for x in want.values()) > 5
    for i, (n, start, length, period, milli, listed, collapsed) in want.items():
        assert tuple(got[i])[1:] == (n, start, length, period, milli, sha(listed), sha(collapsed)), i


def test_runs_awkward(spark):
    rng = random.Random(5)
    texts = [r.text for r in awkward(spark).collect()] + [None, "", " \n ", "a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, "x a b a b a b a b a y", "ü ü\tü ü\nü ü"]
    for _ in range(150):
        base = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        texts.append(" ".join(rng.choice("abc") if rng.random() < 0.04 else base[i % len(base)] for i in range(rng.randrange(70))))
    docs = spark.createDataFrame([(k % 40, t, k) for k, t in enumerate(texts)], "doc_id long, text string, period int").repartition(4)
    for options in ({}, {"min_words": 2, "exponent": 2}, {"min_words": 9, "exponent": 3}):
        got = sorted(str((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, [tuple(x) for x in r.runs], r.collapsed)) for r in runs.periodic_runs(docs, **options).collect())
        want = []
        for k, t in enumerate(texts):
            n, start, length, period, milli, listed, collapsed = brute_row(t, **options)
            want.append(str((k % 40, n, start, length, period, milli, [tuple(map(int, x.split(","))) for x in listed.split()], collapsed)))
        assert got == sorted(want)
    assert runs.periodic_runs(empty(spark)).count() == 0


def test_lyndon_lengths():
    rng = random.Random(2)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(30))]
        want = [next((j - i for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s) - i) for i in range(len(s))]
        assert runs.lyndon_lengths(np.array([-1, *s, -1, *s]))[: len(s) + 1].tolist() == [0, *want] == runs.lyndon_lengths(np.array([-1, *s]))[: len(s) + 1].tolist()


def test_runs_extend_past_hash_errors():
    """Where hashes say too much, the stretch is found word by word."""
    symbols = np.array([-1, 3, 0, 1, 0, 1, 0, 1, 0, 1, 2, -1])
    assert runs._exact(symbols, 4, 2) == (2, 10)


def test_runs_long_text():
    """A text of one period throughout, and one of many periods, in time that follows their length."""
    n = 200_000
    for period in (1, 7, 40_000):
        codes = np.tile(np.arange(period), n // period + 1)[:n]
        assert runs.find_runs(codes, np.zeros(n, dtype=np.int64)).tolist() == [[0, n, period]]


def brute_lines(rows, min_docs=10, min_chars=1, keep_first=False):
    """rows: (id, text), ids not null and distinct where keep_first."""
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    held, first = {}, {}
    for i, lines in split:
        for k in {key(x) for x in lines}:
            held[k] = held.get(k, 0) + 1
        for n, x in enumerate(lines):
            first[key(x)] = min(first.get(key(x), (i, n)), (i, n)) if keep_first else None
    gone = {k for k, n in held.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for i, lines in split:
        kept = [x for n, x in enumerate(lines) if key(x) not in gone or (keep_first and first[key(x)] == (i, n))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()]
    want = [(i, n, d, sha(kept)) for i, n, d, kept in brute_lines(rows)]
    assert sorted(map(tuple, Q.op13_line_dedup(spark, sf).collect()), key=str) == sorted(want, key=str) and sum(r[2] for r in want) > 0


def test_lines_awkward(spark):
    """Both ways of removal, every option, over blanks, repeated rows and one line that all documents have."""
    rng = random.Random(8)
    pool = ["Home | About", " home | about\t", "", "  ", "ü", "x", "A longer line of words.", "a longer line of words. \r", *(f"own {k}" for k in range(40))]
    rows = [(k, "\n".join([*rng.choices(pool, k=rng.randrange(1, 9)), "everywhere"])) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "everywhere"), (204, "everywhere\n" * 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int").repartition(3)
    for options in ({"min_docs": 2}, {"min_docs": 10, "min_chars": 6}, {"min_docs": 3, "keep_first": True}):
        for way in ({}, {"broadcast_keys": 0}):
            scratch = Scratch(spark, "lines-test")
            got = line_dedup.drop_common_lines(docs, **options, **way, scratch=scratch)
            assert sorted(map(tuple, got.collect()), key=str) == brute_lines(rows, **options), (options, way)
            scratch.drop()
    twice = docs.union(docs)
    assert sorted(map(tuple, line_dedup.drop_common_lines(twice, 4, broadcast_keys=0).collect()), key=str) == brute_lines(rows * 2, 4) == sorted(map(tuple, line_dedup.drop_common_lines(twice, 4).collect()), key=str)
    texts = [(r.doc_id, r.text) for r in awkward(spark).select("doc_id", "text").collect()]
    assert sorted(map(tuple, line_dedup.drop_common_lines(awkward(spark), 2).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str) == brute_lines(texts, 2)
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0


def test_twice_seen_misses_nothing(spark):
    """Keys of two documents are in the second filter however small it is; single ones mostly aren't in a roomy one."""
    docs = spark.createDataFrame([(k, f"shared {k % 500}\nsingle {k}") for k in range(1000)], "doc_id long, text string").repartition(7)
    for bits in (1 << 13, 1 << 20):
        bloom = line_dedup.twice_seen(docs, bits, 1, "text")
        held = {}
        for kind in ("shared", "single"):
            (block,) = T.blocks(pa.array(["\n".join(f"{kind} {k}" for k in range(500))]))
            held[kind] = line_dedup._suspected(line_dedup.Lines(block, 1).hash, bloom)
        assert held["shared"].all() and (bits == 1 << 13 or held["single"].mean() < 0.02)


def test_lines_leave_rows_in_proportion(spark, monkeypatch):
    """Five times the lines, on eight times the partitions and a larger filter, leave five times the rows."""
    made, frame = spark.sparkContext.accumulator(0), type(spark.range(0))
    plain = frame.mapInArrow

    def counted(df, func, schema):
        def rows(batches):
            for batch in func(batches):
                made.add(batch.num_rows)
                yield batch

        return plain(df, rows, schema)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    rows = {}
    for n, parts, bits in ((200, 4, 1 << 18), (1000, 32, 1 << 19)):
        docs = spark.createDataFrame([(k, "\n".join([f"shared {k // 2}", *(f"single {k} {i}" for i in range(40))])) for k in range(n)], "doc_id long, text string").repartition(parts, "doc_id")
        before = made.value
        line_dedup.twice_seen(docs, bits, 1, "text")
        rows[n] = made.value - before
    assert 0 < rows[1000] <= 6 * rows[200], rows


def test_lines_of_one_document(spark):
    """The least number of documents is asked for as it stands, one included."""
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, "a"), (3, None)], "doc_id long, text string")
    for way in ({}, {"broadcast_keys": 0}):
        assert sorted(map(tuple, line_dedup.drop_common_lines(docs, 1, **way).collect())) == brute_lines([(1, "a\n\nb"), (2, "a"), (3, None)], 1)


def test_native_planting_needs_no_python(spark, sf):
    plan = Q.with_repetition(documents(spark, sf))._jdf.queryExecution().toString()
    assert "Python" not in plan and F is not None
