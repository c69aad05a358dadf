"""Vector links against brute force; recall of the tables; learned codes."""

import math

import numpy as np

from leafquire.llm import embeddings


def brute(vectors, cosine=0.9):
    ids = [k for k, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(v, float) / np.linalg.norm(np.array(v, float)) for k, v in vectors if k in set(ids)}
    m = np.stack([unit[k] for k in ids]) if ids else np.zeros((0, 1))
    near = m @ m.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], label.max()).min(1)) if len(ids) else label
        if (new == label).all():
            break
        label = new
    out = {k: (0, k) for k, _ in vectors}
    out |= {k: (int(c), int(x)) for k, c, x in zip(ids, near.sum(1), label)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 40)  # so that the hot group is cut into tiles
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(120):
        base = rng.standard_normal(24)
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append(base + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.2, 0.35]))
    hot = rng.standard_normal(24)
    rows += [hot + rng.standard_normal(24) * 0.1 for _ in range(260)] + [hot] * 50 + [hot * 3]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    vectors += [(9000, None), (9001, [0.0] * 24), (9002, [None] + [1.0] * 23), (9003, [float("nan")] * 24), (9004, [float("inf")] * 24), (9005, []), (9006, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in vectors] + [(None, vectors[0][1], 1, 2)], "vec_id long, embedding array<float>, n int, node int").repartition(4)
    want = brute([(k, v) for k, v in vectors if k < 9005]) | {9005: (0, 9005), 9006: (0, 9006)}
    got = embeddings.link(df).collect()
    assert len(got) == len(vectors) + 1
    links = sum(r.n_links for r in got)
    wanted = sum(c for c, _ in want.values())
    assert 0.98 * wanted <= links <= wanted
    agree = 0
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
            continue
        assert r.n_links <= want[r.vec_id][0]
        assert r.kept == (r.vec_id == r.component_id)
        agree += r.component_id == want[r.vec_id][1]
    assert agree >= len(vectors) - 6


def test_recall_on_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([(r.vec_id, r.embedding) for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.op4_embeddings(spark, sf).collect()}
    found, there = sum(c for c, _ in got.values()), sum(c for c, _ in want.values())
    assert found >= 0.9 * there and all(got[k][0] <= want[k][0] for k in want)


def test_codes_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16)) * np.linspace(0.2, 3, 16) + 1.5
    centre, rotations = embeddings.learn_rotations(x, 2)
    for r in rotations:
        assert np.allclose(r.T @ r, np.eye(16), atol=1e-8)
        assert (np.abs(((x - centre) @ r >= 0).mean(0) - 0.5) < 0.06).all()


def test_empty(spark):
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_recall_with_a_common_direction(spark):
    rng = np.random.default_rng(8)
    mean = np.eye(64)[0] * 0.87
    x = mean + rng.standard_normal((6000, 64)) * math.sqrt((1 - 0.87**2) / 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.standard_normal((2000, 64))
    w -= (w * x[:2000]).sum(1, keepdims=True) * x[:2000]
    c = rng.uniform(0.905, 0.93, (2000, 1))
    x = np.concatenate((x, c * x[:2000] + np.sqrt(1 - c * c) * w / np.linalg.norm(w, axis=1, keepdims=True)))
    near = (x @ x.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r.n_links for r in embeddings.link(df).collect()}
    assert all(got[i] <= n for i, n in enumerate(near.tolist()))
    assert sum(got.values()) >= 0.985 * near.sum()


def test_one_key_with_several_vectors_and_other_widths(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0]
    rows = [(5, a), (5, b), (9, b), (9, a), (11, b), (20, [1.0, 0.0]), (21, [2.0, 0.1]), (22, [0.0, 1.0]), (30, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.link(df).collect())
    assert got == [(5, 1, 5), (5, 2, 5), (9, 1, 5), (9, 2, 5), (11, 2, 5), (20, 1, 20), (21, 1, 20), (22, 0, 22), (30, 0, 30)]


def test_plan_grows_with_the_table():
    rng = np.random.default_rng(1)
    data = embeddings.unit_rows(rng.standard_normal(3000 * 64), 64)
    plans = [embeddings.fit_index(data, n) for n in (10**4, 10**6, 10**9)]
    bits = [int(np.bitwise_count(p.masks[0]).sum()) for p in plans]
    assert bits == sorted(bits) and bits[-1] > 16
    assert all(len(p.masks) < n**0.4 for p, n in zip(plans, (10**4, 10**6, 10**9)))
    print(bits, [len(p.masks) for p in plans], [p.most for p in plans])
