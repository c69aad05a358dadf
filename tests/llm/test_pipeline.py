"""The pipeline's stages against brute force, and the native operators' SQL."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafquire.llm import bpe, mixing, quality, queries, sharding, toxicity
from oracle import compare, views
from test_minhash import brute

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    compare(queries.QUERIES[name](spark, SF), views(SF), queries.ORACLES[name])


def passes(text):
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    windows = {}
    for i in range(n - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return not (
        n < 20 or 100 * repeated > 30 * n or 100 * sum(c in "#*$%&|<>" for c in text) > 10 * chars
        or 100 * sum("A" <= c <= "Z" for c in text) > 60 * chars or 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n
        or 100 * (len(lines) - len(set(lines))) > 60 * len(lines) or chars > 30 * n
    )


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "near duplicates", "mixing", "encoding"]

    kept = stages[names[0]](spark, docs, SF)
    kept_ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and kept_ids == {k for k, t in texts.items() if passes(t)}

    calm = stages[names[1]](spark, kept, SF).cache()
    machine = toxicity.Transducers(toxicity.train(kept, spark.read.parquet(f"{SF}/labels.parquet")))
    calm_ids = {k for k in kept_ids if machine.score(machine.features(texts[k])[0]) < toxicity.THRESHOLD}
    assert calm.columns == docs.columns and {r.doc_id for r in calm.collect()} == calm_ids

    once = stages[names[2]](spark, calm, SF).cache()
    classes = brute({k: texts[k] for k in calm_ids}, 5)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(k for k, (_, c) in classes.items() if c == k)

    mixed = stages[names[3]](spark, once, SF).cache()
    sizes = {r.doc_id: len(WORD.findall(r.text)) for r in once.collect()}
    source = {r.doc_id: r.source for r in once.collect()}
    taken = {}
    for r in mixed.collect():
        assert r.text == texts[r.doc_id]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    plan = {r.doc_id: r for r in mixing.mix(once, split=False).collect()}
    assert mixed.columns == docs.columns and max(taken.values()) <= 2
    for s in set(source.values()):
        ids = [k for k in sizes if source[k] == s]
        words = sum(sizes[k] * taken.get(k, 0) for k in ids)
        assert abs(words - plan[ids[0]].target) <= max(sizes[k] for k in ids) / 2 + 1

    out = stages[names[4]](spark, mixed, SF).collect()
    encoder = bpe.Encoder(bpe.Vocabulary.read(open(bpe.tokenizer_path(), encoding="utf-8").read()))
    assert len(out) == sum(taken.values())
    for r in out[:60]:
        assert b"".join(i.to_bytes(4, "little") for i in r.ids) == encoder.block([texts[r.doc_id]])[0] and r.n_tokens == len(r.ids)


def test_run_and_awkward_rows(spark, tmp_path):
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (None, words + " tail", "en", None, None), (2, None, None, "b", 0), (3, "", "en", "b", 0), (4, words + " x", "en", "b", 0), (5, "you idiot " + words[::-1], "en", "b", 0)]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= {1, None} and len({(r.doc_id, tuple(r.ids)) for r in got}) <= 2
    empty = str(tmp_path / "empty")
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_mix_of_awkward_sources(spark):
    rows = [(i, "w " * (i % 7), None if i % 5 == 0 else f"s{i % 3}", "m") for i in range(200)] + [(None, "a b", "s1", "m"), (None, "a b", "s1", "m"), (999, None, "alone", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-6 * total
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and abs(sum(r.taken for r in rs) - rs[0].target) <= 0.5
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(df.repartition(5)).collect() if r.doc_id is not None}
    assert again == {(r.doc_id, r.size): r.taken for r in got if r.doc_id is not None}


def test_shards(spark):
    rows = [(i, f"t{i % 3}", 1) for i in range(-50, 3000)] + [(None, None, 1)] * 3 + [(7, "t1", 1)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = sharding.ledger(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, sharding.SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(sharding.SHARDS))
    wide = {r.doc_id: r.shard for r in sharding.assign(df, "doc_id", sharding.SHARDS + 1).collect()}
    assert all(wide[r.doc_id] == r.grown_shard for r in got)
    moved = sum(r.grown_shard == sharding.SHARDS for r in got)
    assert 0.5 < moved / len(got) * (sharding.SHARDS + 1) < 1.6
    assert sharding.ledger(df.where("false")).count() == 0

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    for r in got:
        assert r.shard == jump((r.doc_id or 0) % 2**64, 40)


def test_ledger_and_ablations(spark):
    df = spark.createDataFrame([(1, "a " * 5), (2, None), (3, "# " * 30), (4, " ".join(f"w{i}" for i in range(50)))], "n_words int, text string")
    out = quality.ledger(df)
    kept = [r.kept for r in quality.apply_policy(out, quality.POLICIES["v1"]).collect()]
    assert kept == [False, False, False, True]
    rows = {r.rule: r for r in quality.ablations(out, quality.POLICIES["v1"]).collect()}
    assert rows["few_words"].n_failed == 2 and rows["symbols"].n_only_here == 0 and rows["few_words"].n_kept_without == 2
    assert quality.ledger(df.where("false")).agg(F.count("*")).first()[0] == 0
