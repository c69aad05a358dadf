"""The stored index against the search in texts and a plain scan."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from leafquire.functions import text as X
from leafquire.operators import keyword, stored


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, content_type string, text string")


def test_same_rows_as_the_search_in_texts(spark, tmp_path):
    rng = random.Random(3)
    words = ["ab", "abab", "b", "연구", "연구비", "A1", "xyz", "x", "😀가", "가나다라"]
    rows = [(f"c{i}", f"d{i % 3}", "text", rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [("empty", "d0", "text", ""), ("null", "d0", "text", None), ("twin", "d1", "text", rows[5][3]), ("long", "d1", "text", "abab 연구비 " * 20_000)]
    chunks = table(spark, rows).repartition(3)
    queries = spark.createDataFrame(
        [(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))), rng.choice([None, "d1"]), None) for i in range(40)] + [("none", "?!", None, None), ("gone", "zzzz qq", None, None)],
        "query_id string, query string, doc_id string, content_type string")
    for width in (1, 7, 64):
        path = str(tmp_path / str(width))
        stored.write_index(chunks, path, width)
        blocks, counts = stored.read_index(spark, path)
        got = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in stored.search(queries, blocks, counts, 20).collect()}
        want = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in keyword.keyword_search(queries, chunks, k=20).collect()}
        assert got == want and len(got) > 300
    every = [["ab", "ba"], ["연구"], ["zz"]]
    read = stored.matches_in(every, blocks, counts).agg({"looked": "sum", "skipped": "sum"}).first()
    assert sum(read) == 3 * blocks.count() and read["sum(skipped)"] >= blocks.count()


def test_empty_index(spark, tmp_path):
    stored.write_index(table(spark, []), str(tmp_path / "x"))
    blocks, counts = stored.read_index(spark, str(tmp_path / "x"))
    queries = spark.createDataFrame([("q", "ab", None, None)], "query_id string, query string, doc_id string, content_type string")
    assert stored.search(queries, blocks, counts).count() == 0


def test_codes_are_one_to_one():
    terms = ["a", "b", "ab", "ba", "가", "가나", "😀", "😀a"]
    assert len({stored.code(t) for t in terms}) == len(terms)
    block = {"codes": np.array([1, 2, 1]), "terms": np.array([1, 2]), "firsts": np.array([0, 2]), "places": np.array([0, 2, 1]), "n": np.array([2, 1])}
    plan = np.array([1, 2, 1, 2, 1]), np.array([0, 2, 4]), np.array([2, 2, 1]), np.array([1, 0, 0])
    chunk, phrase, times, skipped = stored.find_in(block, plan)
    assert list(zip(chunk.tolist(), phrase.tolist(), times.tolist())) == [(0, 0, 1), (0, 1, 1), (0, 2, 1), (1, 2, 1)] and skipped == 0


def test_codes_are_those_of_the_terms(spark):
    texts = ["ab", "a b, c", "x", "", "A1b-2 가나 다", "😀가😀가나", "İstanbul ßß K9", "한글ab cd́e", "a￿ b\U0010fffe"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", X.grams(F.col("text")).alias("gs"), F.lower("text").cast("binary").alias("low"))
    for r in rows.collect():
        assert stored.cut(bytes(r.low)).tolist() == [stored.code(t) for t in r.gs]
    assert not len(stored.cut(b"\xff \xed\xa0\x80")) and len(stored.cut(b"ab\xffcd")) == 2


def test_blocks_and_row_groups_are_bounded(spark, tmp_path):
    """64 long chunks are many blocks, and a reader never holds many of them at once."""
    rng = random.Random(5)
    rows = [(f"c{i}", "d", "text", " ".join(rng.choice(("abcde", "xyz", "연구비")) + str(rng.randint(0, 999)) for _ in range(4_000))) for i in range(300)]
    stored.write_index(table(spark, rows).coalesce(1), str(tmp_path / "x"))
    blocks, counts = stored.read_index(spark, str(tmp_path / "x"))
    held = blocks.select(F.size("n").alias("chunks"), F.expr("aggregate(n, 0, (a, x) -> a + x)").alias("terms")).collect()
    assert sum(r.chunks for r in held) == 300 and sum(r.terms for r in held) == counts.agg(F.sum("n")).first()[0]
    assert max(r.terms for r in held) <= 1 << 18
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/x/blocks/*.parquet")]
    groups = [f.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
    assert max(groups) <= 40 << 20 and sum(groups) <= 3 * sum(r.terms for r in held)


def test_more_terms_than_two_bytes_number():
    codes = np.random.default_rng(1).permutation(np.repeat(np.arange(70_000) * 3, 2))
    terms, times, packed = stored._pack(codes)
    block = stored.unpack(terms, times, packed)
    assert (block["codes"] == codes).all() and (times == 2).all()
    assert (codes[block["places"]] == np.repeat(terms, times)).all() and (block["firsts"] == np.arange(70_000) * 2).all()
