"""Phrases against a search in the sample; accuracy on rows that are held out."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from leafquire.llm import language


def slow(text: bytes, sample: bytes, lane=language.LANE) -> int:
    """Phrases of a greedy parse by plain search, lane by lane."""
    n = 0
    for at in range(0, len(text), lane):
        piece, i = text[at : at + lane], 0
        while i < len(piece):
            j = i + 1
            while j <= len(piece) and piece[i:j] in sample:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
    return n


def test_phrases_equal_a_plain_search():
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    samples = [" ".join(word(x) for _ in range(300)).encode() for x in ("abcde", "cdefgh", "é中x")]
    parser = language.Parser(language.Model(["a", "b", "c"], samples))
    texts = [b"", b"a", b"zzz", b" ", samples[0], samples[1][5:1400] * 2] + [" ".join(word("abcdefghzé") for _ in range(rng.randint(0, 200))).encode() for _ in range(40)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    got = parser.phrases(data, starts)
    assert got.tolist() == [[slow(t, s) for s in samples] for t in texts]


def test_automaton_reads_every_stretch_and_nothing_else():
    text = b"abracadabra abba"
    step = language.suffix_automaton(text)

    def reads(word):
        state = 0
        for c in word:
            if c not in step[state]:
                return False
            state = step[state][c]
        return True

    rng = random.Random(1)
    for _ in range(2000):
        word = bytes(rng.choice(b"abrcd ") for _ in range(rng.randint(0, 5)))
        assert reads(word) == (word in text)


def test_held_out_rows(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        got = language.op12_language(spark, sf)
        assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
        rows = got.join(docs, "doc_id").collect()
        assert len(rows) == docs.count()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.held_out]
        assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, "wort und tag " if i % 2 else "word and day ", "x" if zlib.crc32(str(i).encode()) % 5 == 0 else "ab"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    assert language.train(docs.where(~language.held_out(F.col("doc_id")))).languages == ["a", "b"]


def test_nulls_long_texts_and_clashes(spark):
    model = language.Model(["de", "en"], [b"das ist ein tag und eine nacht", b"this is a day and a night"])
    rows = [(1, None, 1), (1, "", 1), (None, "1234 !?", 1), (2, "This is a DAY. " * 100_000, 2), (3, "eine Nacht", 3), (3, "eine Nacht", 3), (4, "中文", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(2)
    out = language.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred) for r in out.collect()]
    assert sorted(got, key=str) == [(1, "und"), (1, "und"), (2, "en"), (3, "de"), (3, "de"), (4, "en"), (None, "und")]
    assert all(r.score == 0 for r in out.where("lang_pred = 'und'").collect())
    assert language.identify(df, language.Model([], [])).where("lang_pred = 'und' AND score = 0").count() == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(empty, language.train(empty)).count() == 0
    assert language.identify(empty, model).count() == 0
    only = spark.createDataFrame([(1, None, "en"), (2, "..", "fr"), (3, "word", None)], "doc_id long, text string, lang string")
    assert language.train(only).languages == []
