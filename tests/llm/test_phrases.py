"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from leafquire.llm import phrases, queries
from oracle import compare, views


def slow(rows, longest=3, threshold=10, top=2000, cover=50):
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(ws)
            f.update((lang, ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= threshold}
    inside = {}
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = lang, p[i : i + k]
                inside[key] = max(inside.get(key, 0), a)
    for (lang, p), a in often.items():
        if 100 * inside.get((lang, p), -1) >= cover * a:
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    ranked, last, rank = [], None, 0
    for lang, score, a, p, l, r in sorted(out):
        rank = rank + 1 if lang == last else 1
        last = lang
        if rank <= top:
            ranked.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return ranked


def answer(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def table_of(seed, rows):
    rng = random.Random(seed)
    words = ["the", "The", "a", "É", "of", "x1", "zz", "ab-c", "中", " "]
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", " "]
    out = []
    for _ in range(rows):
        text = "".join(rng.choice(words[: rng.randint(1, 10)]) + rng.choice(gaps) for _ in range(rng.randint(0, 40)))
        out.append((text, rng.choice(["en", "fr", None, "und", ""])))
    return out


@pytest.mark.parametrize("seed, longest, shards, threshold, bits", [(1, 3, 3, 10, 1 << 26), (2, 3, 1, 10, 64), (3, 4, 4, 5, 1 << 12), (4, 2, 2, 10, 1 << 16)])
def test_equals_a_plain_count(spark, seed, longest, shards, threshold, bits):
    """Whatever the cycle, and also with bit maps so small that they let nearly everything through."""
    rows = table_of(seed, 120)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    counts = phrases.count_phrases(df, longest=longest, threshold=threshold, shards=shards, bits=bits, block=2_000)
    assert answer(phrases.collocations(counts, threshold)) == slow(rows, longest, threshold)


def test_phrases_that_pass_late(spark):
    """Rare phrases pass only in the last scan of a cycle and still get a cycle of their own."""
    rows = [("p q r", "en")] * 10 + [(f"u{i} v{i} w{i}", "en") for i in range(40)] + [("p q", "en"), ("q r", "en")] * 3
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert answer(phrases.collocations(phrases.count_phrases(df, shards=3))) == slow(rows)


def test_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_000_019, 3_000_000_000_023, 3_100_000_000_001
    rows = [("en", 0, "", l + r), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)]
    got = answer(phrases.collocations(spark.createDataFrame(rows, "lang string, n int, phrase string, f long")))
    assert got == [("en", 1, "x y", a, l, r, l + r, 10**6 * a * a // (l * r))]


def test_nulls_long_texts_and_clashes(spark):
    rows = [(None, None, 1), ("", "en", 2), (" Big cats, " * 50_000, None, 3), ("big cats", "und", 4), ("big cats", "und", 4)]
    df = spark.createDataFrame(rows, "text string, lang string, n int")
    got = answer(phrases.collocations(phrases.count_phrases(df, block=100_000)))
    assert got == [("und", 1, "big cats", 50_002, 50_002, 50_002, 100_004, 10**6)]
    empty = spark.createDataFrame([], "text string, lang string")
    assert answer(phrases.collocations(phrases.count_phrases(empty))) == []


def test_query_equals_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        compare(phrases.op11_phrases(spark, sf), views(sf), queries.ORACLES["op11_phrases"])
