"""How often the build moves the texts of its lines."""

import random

from leafquire import catalog


def _shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_the_build_shuffles_texts_a_few_times_only(spark, tmp_path):
    rng = random.Random(7)
    text = lambda: "\n".join("Title " + rng.randbytes(3).hex() if i % 9 == 2 else rng.randbytes(1_000).hex() + " a b" for i in range(24))
    rows = [(i, text()) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(len(t) for _, t in rows) / 2  # two letters of hex hold a byte
    before = _shuffled(spark)
    got = catalog.QUERIES["corpus_build"](spark, str(tmp_path)).select("doc_id", "text").collect()
    moved = _shuffled(spark) - before
    made = {i: " ".join(r.text for r in got if r.doc_id == str(i)) for i in range(3)}
    lost = [w for i in made for n, line in enumerate(rows[i][1].split("\n")) for w in line.split()[:1] if n % 8 not in (0, 7) and n > 8 and len(w) > 9 and w not in made[i]]
    assert not lost
    assert moved < 8 * size, f"{moved / size:.1f} times the texts"
