"""Encoding against the tokenizers library, decoding as an exact round trip."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafquire.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


def samples():
    rng = random.Random(3)
    letters = "aabbcdefgh the ing ion é ü ß ñ Σ İ ﬁ 中文 ✓ 😀 ' 's 'LL 0 12 !!! \n\t\u0085  <|endoftext|> <|startoftext|> é"
    out = ["", " ", "\n", "a", "aaaaaaaaaaaaaaaaaaaaaaa", "abababab", "<|endoftext|>", "x<|endoftext|>y", "é<|startoftext|>́",
           "x" * 5000, "ab" * 4000, "Hello, World's 'TIS 12345", "\u0000\u001c​﻿", "ΑΣ ΣΑ"]
    for _ in range(300):
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))
    for _ in range(200):
        out.append("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x370, 0x1FFF), rng.randint(0x4E00, 0x4EFF)])) for _ in range(25)))
    return out


def test_words_equal_the_library(library):
    encoder = bpe.Encoder(bpe.Vocabulary.read(open(bpe.tokenizer_path(), encoding="utf-8").read()))
    texts = samples()
    for text, ids in zip(texts, encoder.block(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_columns_nulls_and_decoding(spark, library):
    texts = samples()
    rows = [(i, t, "mine", [9]) for i, t in enumerate(texts)] + [(None, None, None, None), (1, "twice", "x", []), (1, "twice", "x", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    out = bpe.decode(bpe.encode(df))
    assert out.count() == len(rows)
    for r in out.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids if r.text else []
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    digest = {r.doc_id: r for r in bpe.digests(out.select("doc_id", "ids")).collect()}
    ids = library.encode(texts[11], add_special_tokens=False).ids
    assert digest[11].n_tokens == len(ids)
    assert digest[11].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert digest[11].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert digest[None].n_tokens == 0


def test_rows_leave_a_task_in_blocks(library):
    """One batch, as Spark sends up to 10,000 rows, must not come back as one batch with all its texts and ids."""
    vocab = bpe.Vocabulary.read(open(bpe.tokenizer_path(), encoding="utf-8").read())
    texts = [None, "", *(f"row {i} é {'some words ' * 60}" for i in range(3000)), "中文 " * (bpe.TEXT_BLOCK // 3), None, "end"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = list(bpe.encoded([batch.slice(0, 0), batch], vocab, "text", [0], ["doc_id", "ids"]))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(b.schema.names == ["doc_id", "ids"] for b in out)
    sizes = [sum(len((texts[i] or "").encode()) for i in b.column("doc_id").to_pylist()) for b in out]
    assert len(out) > 4 and all(n <= bpe.TEXT_BLOCK or b.num_rows == 1 for n, b in zip(sizes, out))
    got = [r for b in out for r in b.column("ids").to_pylist()]
    for k in (0, 1, 2, 700, 3001, 3002, 3003, 3004):
        assert got[k] == (library.encode(texts[k], add_special_tokens=False).ids if texts[k] else [])


def test_columns_that_stay(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "k long, text string, ids string")
    assert bpe.encode(df).columns == ["k", "text", "ids"]
    assert bpe.encode(df, keep_text=False).columns == ["k", "ids"]
    assert bpe.encode(df, ids="text").columns == ["k", "ids", "text"]
    assert [(r.k, len(r.text), r.ids) for r in bpe.encode(df, ids="text").orderBy("k").collect()] == [(1, 2, "x"), (2, 0, "y")]


def test_unknown_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, [-1, 0, 10**6]), (2, None), (3, [])], "k long, ids array<int>")
    assert [r.decoded for r in bpe.decode(df).orderBy("k").collect()] == ["!", "", ""]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode(empty).drop("text")).count() == 0
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_query_on_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = bpe.op7_bpe(spark, sf).withColumn("z", F.lit(1)).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
