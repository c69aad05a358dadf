"""Versions of stored tables: whole or not there, and nothing twice."""

import pytest
from pyspark.sql import functions as F

from leafquire.sources import tables
from leafquire.sources.store import Conflict, Store


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_rebuild_that_dies_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.manifest() == {}
    one, two = (spark.createDataFrame([("a", v), ("b", v)], "doc_id string, v int") for v in (1, 2))
    assert store.publish({"x": one, "y": one}) == 1

    @F.udf("int")
    def dies(v):
        raise ValueError("killed")

    with pytest.raises(Exception, match="killed"):
        store.publish({"x": two, "y": two.withColumn("v", dies("v"))})
    assert store.version() == 1
    assert _rows(store.read("x")) == _rows(store.read("y")) == [("a", 1), ("b", 1)]
    assert store.publish({"x": two}) == 2
    assert _rows(store.read("x")) == [("a", 2), ("b", 2)] and _rows(store.read("y")) == [("a", 1), ("b", 1)]
    assert _rows(store.read("x", 1)) == [("a", 1), ("b", 1)]


def test_documents_are_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    schema = "doc_id string, v int, m map<string,int>"
    names = [None, *(f"d{i}" for i in range(60))]
    rows = spark.createDataFrame([(d, v, {"k": v}) for d in names for v in (1, 2)], schema)
    store.publish({"x": rows}, by_document=("x",), buckets=8)
    new = spark.createDataFrame([("d1", 9, None), (None, 7, None), ("d5", 5, None)], schema)
    docs = spark.createDataFrame([("d1",), ("d2",), (None,)], "doc_id string")
    store.replace("x", new, docs)
    plain = lambda df: sorted(((r.doc_id, r.v) for r in df.collect()), key=str)
    want = [(d, v) for d in names if d not in ("d1", "d2", None) for v in (1, 2)] + [("d1", 9), (None, 7)]
    assert plain(store.read("x")) == sorted(want, key=str)
    assert len(plain(store.read("x", 1))) == 2 * len(names)
    assert len(store.manifest()["x"]["folders"]) <= 8
    # Buckets without one of the documents keep their folders.
    before, after = (store.manifest(v)["x"]["folder_of"] for v in (1, 2))
    assert set(before) == set(after) and sum(before[b] == after[b] for b in before) >= 5


def test_an_empty_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish({"x": spark.createDataFrame([], "doc_id string, v int")}, by_document=("x",))
    assert store.read("x").count() == 0 and store.read("x").columns == ["doc_id", "v"]


def test_vectors_are_stored_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    chunks = spark.createDataFrame([("1", "d", "text", "old"), ("2", "d", "text", "new"), ("3", "d", "text", "new")], "chunk_id string, doc_id string, content_type string, text_for_embedding string")

    def fails(texts):
        raise ValueError("no answer")

    tables.grow_vectors(store, chunks.where("chunk_id = 1"), "m", lambda texts: [[1.0]] * len(texts))
    with pytest.raises(Exception, match="no answer"):
        tables.grow_vectors(store, chunks, "m", fails)
    for value in (2.0, 3.0):
        got = tables.grow_vectors(store, chunks, "m", lambda texts: [[value]] * len(texts))
        assert {r.chunk_id: r.embedding for r in got.collect()} == {"1": [1.0], "2": [2.0], "3": [2.0]}
    assert store.read("embeddings").count() == 2


def test_two_jobs_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("a", 1)], "doc_id string, v int")
    store.publish({"x": df})
    late = store.version()
    store.publish({"x": df.withColumn("v", F.lit(2))})
    with pytest.raises(Conflict):
        store._commit(store.manifest(late), late)
    assert _rows(store.read("x")) == [("a", 2)]
