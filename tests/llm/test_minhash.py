"""Near duplicates against brute force over all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from leafquire.llm import minhash


def shingle_set(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1)))


def brute(texts, size, percent=80):
    sets = {k: shingle_set(t, size) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for k in sorted(sets):
        seen = {}
        for s in sets[k]:
            for o in index.setdefault(s, []):
                seen[o] = seen.get(o, 0) + 1
            index[s].append(k)
        for o, both in seen.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[o]) - both):
                a, b = sorted((find(k), find(o)))
                parent[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    out, k = {}, 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out[k] = rng.choice([" ", "\n", "\t "]).join(copy)
            k += 1
    chain = [f"c{i}" for i in range(140)]
    for i in range(0, 60, 6):  # each linked with its neighbours only
        out[k] = " ".join(chain[i : i + 80])
        k += 1
    return out


def test_equals_brute_force(spark):
    texts = corpus(1) | {9000: None, 9001: "", 9002: " \n", 9003: "x" * 200_000, 9004: "a b c " * 30_000}
    rows = [(k, t, 0, "n") for k, t in texts.items()] + [(None, "a b c d e f", 1, "n"), (3, texts[3], 0, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, regs string").repartition(5)
    for size in (4, 5):
        want = brute(texts, size)
        got = minhash.near_duplicates(df, size=size).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert (r.component_id, r.kept) == (None, True)
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id], r
                assert r.kept == (r.doc_id == r.component_id)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = brute(texts, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op2_minhash(spark, sf).collect()} == want


def test_estimate_is_corrected():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.5, 0.9):
        both = rng.integers(0, 2**63, int(4000 * share), dtype=np.uint64)
        a = np.concatenate((both, rng.integers(0, 2**63, 4000 - len(both), dtype=np.uint64)))
        b = np.concatenate((both, rng.integers(0, 2**63, 4000 - len(both), dtype=np.uint64)))
        est = minhash.estimate(minhash.registers(a), minhash.registers(b), np.array([4000]), np.array([4000]))[0]
        assert abs(est - len(both) / (8000 - len(both))) < 0.13


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert minhash.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.sum("n_shingles")).first()[0] == 0


def test_one_key_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (7, " ".join(f"c{i}" for i in range(60))), (7, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (7, 56, 1), (7, 56, 7)]


def test_one_of_each(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " more", "x"), (3, b + " more", "x"), (3, b + " more", "x"), (4, "short", "x"), (5, None, "x"), (6, None, "y"), (None, a, "x"), (None, a, "x"), (1, b, "x"), (9, "alone here", "x"), (9, "alone here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _print string").repartition(4)
    out = minhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(1, a), (1, b), (4, "short"), (5, ""), (6, ""), (0, a), (0, a), (9, "alone here")])
    assert minhash.one_of_each(df.where("false")).count() == 0


def test_few_strays_send_a_bucket_once(spark):
    """Tiles follow the number of strays; each stray still meets each member in exactly one tile."""
    for n, strays in ((20_000, 1), (5_000, 3_000)):
        members = spark.range(n).selectExpr("7L AS bucket", "0 AS band", "id AS node", f"CASE WHEN id < {strays} THEN id ELSE -1L END AS comp", "50L AS n", "X'00' AS regs")
        members = members.selectExpr("*", "comp = -1 AS main", f"{n}L AS size", f"{50 * n}L AS shingles", f"{strays}L AS strays", f"{50 * strays}L AS stray_shingles")
        tiled = minhash._tiled(members)
        if strays == 1:
            assert tiled.count() <= 2 * n
        left, right = tiled.where("side = 0").select("i", "j", "node"), tiled.where("side = 1").select("i", "j", F.col("node").alias("other"))
        met = left.join(right, ["i", "j"]).agg(F.count("*"), F.countDistinct("node", "other")).first()
        assert tuple(met) == (n * strays, n * strays)
        assert tiled.groupBy("i", "j", "side").count().agg(F.max("count")).first()[0] <= 1.3 * minhash.TILE


def shuffled(df):
    """Bytes that ``df`` sends through its exchanges, before they are compressed."""
    df.collect()
    todo, size = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.finalPhysicalPlan())
        elif "QueryStage" in name:
            todo.append(plan.plan())
        elif name == "Exchange":
            size += plan.metrics().apply("dataSize").value()
        todo.extend(plan.children().apply(i) for i in range(plan.children().size()))
    return size


def test_single_texts_are_not_shuffled(spark):
    rows = [(i, " ".join(f"{i}x{j}" for j in range(100))) for i in range(600)]
    rows += [(600 + i, rows[i][1] + " tail") for i in range(40)] + rows[50:55]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = minhash.one_of_each(df)
        assert sorted(r.doc_id for r in out.collect()) == list(range(600))
        assert 0 < shuffled(out) < 0.5 * sum(len(text) for _, text in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_registers_of_no_pair_are_not_shuffled(spark, tmp_path):
    rows = [(i, 50, np.full(minhash.REGISTERS, i, np.uint16).tobytes()) for i in range(1000)] + [(5000, 50, np.full(minhash.REGISTERS, 7, np.uint16).tobytes())]
    spark.createDataFrame(rows, "node long, n long, regs binary").write.parquet(f"{tmp_path}/classes")
    spark.createDataFrame([(7, 5000), (3, 4)], "a long, b long").write.parquet(f"{tmp_path}/pairs")
    pairs, classes = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("pairs", "classes"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = minhash.estimated(pairs, classes, 80)
        assert [(r.a, r.b) for r in out.collect()] == [(7, 5000)]
        assert 0 < shuffled(out) < 0.1 * sum(len(regs) for _, _, regs in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
