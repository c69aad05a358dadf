"""Exact search in stored clusters against the full scan and plain loops."""

import numpy as np

from leafquire.operators import clusters, search

VECTOR = "chunk_id string, embedding array<double>, doc_id string, content_type string"
QUERY = "query_id string, embedding array<double>, doc_id string, content_type string"


def rows(found):
    return {(r.query_id, r.rank): (r.chunk_id, round(r.distance, 9)) for r in found.collect()}


def grouped(rng, n, groups=12, parts=8):
    centres = rng.normal(size=(groups, parts)) * 4
    return centres[rng.integers(groups, size=n)] + rng.normal(size=(n, parts)) * 0.3


def test_same_rows_as_the_full_scan_and_less_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = grouped(rng, 3000)
    v[1000:2000] = v[7]  # a third of all rows are one vector
    stored = [(f"c{i:04d}", x.tolist(), rng.choice(["a", "b", None]), rng.choice(["text", "table"])) for i, x in enumerate(v)]
    stored += [("null", None, "a", "text"), ("zero", [0.0] * 8, "a", "text"), ("nan", [float("nan")] * 8, "a", "text"), ("hole", [None] * 8, "a", "text"), ("few", v[3].tolist(), "c", None)]
    vectors = spark.createDataFrame([(a, b, c and str(c), d and str(d)) for a, b, c, d in stored], VECTOR).repartition(4)
    asked = [(f"q{i}", v[i * 40].tolist(), [None, "a", "c", "gone"][i % 4], [None, "text"][i // 4 % 2]) for i in range(60)]
    asked += [("far", (-v[0]).tolist(), None, None), ("none", None, None, None), ("empty", [0.0] * 8, None, None)]
    queries = spark.createDataFrame(asked, QUERY)
    want = rows(search.vector_search(queries.where("query_id != 'empty'"), vectors.where("chunk_id NOT IN ('nan', 'hole')"), 25))
    for n, width in ((1, 7), (300, 64)):
        path = str(tmp_path / f"{n}-{width}")
        clusters.write_clusters(vectors, path, n, width)
        store = clusters.read_clusters(spark, path)
        assert rows(clusters.search(queries, store, 25)) == want and len(want) > 700
        assert store.pivots.agg({"n": "sum"}).first()[0] == 3001
    free = queries.where("doc_id IS NULL AND content_type IS NULL AND query_id LIKE 'q%'")
    share = [r.n / 3001 for r in clusters.compared(free, store, 25).collect()]
    assert len(share) == free.count() and np.mean(share) < 0.5


def test_bounds_hold_for_unclustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 5))
    vectors = spark.createDataFrame([(str(i), x.tolist(), None, None) for i, x in enumerate(v)], VECTOR)
    queries = spark.createDataFrame([(str(i), rng.normal(size=5).tolist(), None, None) for i in range(20)], QUERY)
    clusters.write_clusters(vectors, str(tmp_path / "x"))
    got = rows(clusters.search(queries, clusters.read_clusters(spark, str(tmp_path / "x")), 9))
    unit = lambda x: x / np.linalg.norm(x)
    for q in queries.collect():
        d = np.array([np.linalg.norm(unit(x) - unit(np.array(q.embedding))) for x in v])
        order = sorted(range(400), key=lambda i: (d[i], str(i)))[:9]
        assert [got[q.query_id, r + 1] for r in range(9)] == [(str(i), round(d[i], 9)) for i in order]


def test_empty_tables(spark, tmp_path):
    some = spark.createDataFrame([("a", [1.0, 0.0], "d", "text")], VECTOR)
    asked = spark.createDataFrame([("q", [1.0, 0.0], None, None), (None, [1.0, 0.0], None, None)], QUERY)
    clusters.write_clusters(some.limit(0), str(tmp_path / "none"))
    clusters.write_clusters(some, str(tmp_path / "one"))
    none, one = (clusters.read_clusters(spark, str(tmp_path / n)) for n in ("none", "one"))
    assert clusters.search(asked, none).count() == 0
    assert clusters.search(asked.limit(0), one).count() == 0
    assert rows(clusters.search(asked, one)) == {("q", 1): ("a", 0.0)}


def test_pivots_of_equal_rows():
    assert len(clusters.fit(np.ones((50, 3)), 7)) == 1
    assert clusters.fit(np.empty((0, 3)), 7).shape == (0, 3)
