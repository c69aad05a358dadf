"""Passes over ranges: equal to one pass over everything, and no task holds a large group."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafquire.operators import blocks, layout, ranges


def _by_hand(sizes, limit, state=None):
    runs = []
    for n in sizes:
        if state is None:
            state = n, 0
        elif state[0] + n > limit:
            state = n, state[1] + 1
        else:
            state = state[0] + n, state[1]
        runs.append(state[1])
    return state, runs


def test_outcomes_compose():
    rng = random.Random(3)
    for _ in range(1500):
        limit = rng.choice([0, 1, 5, 20])
        sizes = [rng.choice([0, 0, 1, 2, 3, 7, 25]) for _ in range(rng.randint(1, 14))]
        outcome = ranges.outcomes(np.asarray(sizes), limit)
        assert len(outcome[0]) <= limit + 2
        for state in [None, *((t, 4) for t in range(limit + 3))]:
            want, _ = _by_hand(sizes, limit, state)
            got = ranges.after(state, outcome, limit)
            assert (min(got[0], limit + 1), got[1]) == (min(want[0], limit + 1), want[1]), (sizes, limit, state)


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_packing_over_ranges(spark, parts):
    rng = random.Random(int(parts))
    rows = [(d, i, rng.choice([0, 0, 1, 3, 9, 40])) for d in ("a", None, "b", "c") for i in range(rng.choice([1, 3, 200]) if d != "b" else 700)]
    was = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.d, r.i): r.run for r in ranges.packed(spark.createDataFrame(rows, "d string, i int, n int"), ["d"], ["i"], "n", 20).collect()}
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    want = {}
    for d in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == d]
        want.update({(d, r[1]): run for r, run in zip(mine, _by_hand([r[2] for r in mine], 20)[1])})
    assert got == want


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], "d string, i int, n int")
    assert ranges.packed(empty, ["d"], ["i"], "n", 5).count() == 0


N = 1_000_000


def _one_document(spark):
    return spark.range(N).select(
        F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("line_no"), (F.col("id") / 8 + 1).cast("int").alias("page_pdf"), (100.0 + 70 * (F.col("id") % 8)).alias("y0"),
        F.format_string("line %d", "id").alias("text"),
    )


def test_one_document_of_a_million_lines(spark):
    lines = _one_document(spark)
    pages = [3, 4, 60_000, 60_001, 124_999]
    spans = spark.createDataFrame([("d", p, 240.0, i + 1) for i, p in enumerate(pages)], "doc_id string, page_pdf int, y0 double, place int")
    got = layout.assign(lines, spans)
    # The heading stands on line 2 of its page; that line and no other is too near.
    starts = [(p - 1) * 8 + 2 for p in pages]
    found = {r.place: (r.lo, r.hi, r.n) for r in got.groupBy("place").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count("*").alias("n")).collect()}
    bounds = [-1, *starts, N]
    assert found == {i: (bounds[i] + 1, bounds[i + 1] - 1, bounds[i + 1] - bounds[i] - 1) for i in range(len(pages) + 1)}
    assert bisect.bisect(starts, 17) == 0
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= N / 2


def test_one_island_of_a_million_lines(spark):
    out = blocks.pack_lines(_one_document(spark), ["doc_id"], ["line_no"])
    rows = out.select("run", F.length("text").alias("n"), (F.size(F.split("text", "\n"))).alias("k")).orderBy("run").collect()
    _, runs = _by_hand([len(f"line {i}") for i in range(N)], 700)
    want = np.bincount(runs).tolist()
    assert [r.k for r in rows] == want and [r.run for r in rows] == list(range(len(want)))
