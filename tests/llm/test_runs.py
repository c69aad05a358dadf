"""Runs against a scan of every period, on hand-made, random and given texts."""

import hashlib
import random
import re
import zlib

import numpy as np

from leafquire.llm import runs


def slow(words, least=12):
    """All runs by comparing the text with itself at every distance."""
    found, w = {}, np.array([hash(x) for x in words], dtype=np.int64)
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate(([0], (w[q:] == w[:-q]).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + q >= max(least, 2 * q):
                found.setdefault((a, b - a + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def fast(texts, least=12):
    bounds, start, length, period, collapsed = runs._block([[w.encode() for w in t] for t in texts], least)
    rows = list(zip(start.tolist(), length.tolist(), period.tolist()))
    return [(rows[bounds[i] : bounds[i + 1]], collapsed[i].decode()) for i in range(len(texts))]


def texts():
    rng = random.Random(5)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 1000, list("ab" * 6), list("abc" * 30 + "d" + "abc" * 30), list("ab" * 6 + "a") * 2, list("b" + ("ab" * 6 + "a") * 2 + "b")]
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    out.append(list(fib[-1]))
    out.append([str(bin(i).count("1") % 2) for i in range(512)])
    out.append(list("a" * 40 + "z" + "a" * 40 + "z" + "a" * 40))
    for letters, n in ((2, 60), (2, 400), (3, 200), (1, 50)):
        out += [[rng.choice("abc"[:letters]) for _ in range(rng.randint(1, n))] for _ in range(150)]
    for _ in range(200):
        text = []
        while len(text) < rng.randint(10, 300):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
            text += (unit * rng.randint(1, 6))[: rng.randint(1, 150)]
        out.append(text)
    return out


def test_blocks_equal_a_scan_of_all_periods():
    cases = texts()
    for text, (found, collapsed) in zip(cases, fast(cases)):
        want = slow(text)
        assert found == want, text
        assert collapsed == kept(text, want)


def test_other_least_lengths():
    cases = texts()[:120]
    for text, (found, _) in zip(cases, fast(cases, 20)):
        assert found == slow(text, 20)


def test_successor_and_suffix_order():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)
    tree = runs.WaveletTree(values, 300)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(300, lo + rng.integers(0, 60, 500))
    x = rng.integers(0, 300, 500)
    want = [min([v for v in values[a:b] if v >= c], default=300) for a, b, c in zip(lo, hi, x)]
    assert tree.successor(lo, hi, x).tolist() == want
    text = np.append(rng.integers(1, 3, 200), 0)
    assert runs.Suffixes(text).order.tolist() == sorted(range(201), key=lambda i: text[i:].tolist())


def test_nulls_long_texts_and_clashes(spark):
    rows = [(1, None, 7), (1, "", 7), (None, " a\tb " * 9, None), (2, "x " * 300_000, 1), (2, "x " * 300_000, 1), (3, "    " * 12, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(2)
    out = runs.find_runs(df)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    got = sorted(((r.doc_id or 0, r.text or "", [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    assert [x[2:] for x in got] == [([(0, 18, 2)], "a b"), ([], ""), ([], ""), ([(0, 300_000, 1)], "x"), ([(0, 300_000, 1)], "x"), ([(0, 24, 1)], " ")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.find_runs(empty).count() == 0


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = runs.op13_runs(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) > 50
    for r in got:
        ws = plant(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id]))
        want = slow(ws)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(ws, want).encode()).hexdigest()
        s, n, q = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q if n else None)
