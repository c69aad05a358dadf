"""The transducers by example; held-out accuracy; nulls and long texts."""

import zlib

from pyspark.sql import functions as F

from leafquire.llm import toxicity


def said(text, grammar=None):
    return {k: v for _, _, c in toxicity.Transducers(grammar or toxicity.seeds()).matched(text) for k, v in c.items() if v}


def test_transducers():
    assert said("a fine day. what an idiot! bye") == {"plain": 1.0}
    assert said("You are a pathetic IDIOT, really") == {"aimed": 2.0}
    assert said("idiot that you are") == {"aimed": 1.0}
    assert said("this is not stupid at all") == {"negated": 1.0}
    assert said("she said it was trash") == {"reported": 1.0}
    assert said('the sign "trash" is old') == {"reported": 1.0}
    assert said("i will kill you") == {"threat": 1.0}
    assert said("to kill time") == {}
    assert said("idiotic antimoronic xstupid") == {}
    assert said("moron### |stupid|") == {"plain": 1.0}
    assert said("vequxyz", toxicity.Grammar({"vequ*": 0.7})) == {"plain": 0.7}
    assert [c[:2] for c in toxicity.Transducers(toxicity.seeds()).matched("ok. an idiot; a clown")] == [(3, 12), (13, 21)]


def test_order_of_scores():
    m = toxicity.Transducers(toxicity.seeds())
    score = lambda t: m.score(m.features(t)[0])
    assert score("you idiot") > score("an idiot") > score("not an idiot") > score("a fine day") == score("") == score(None)
    assert 0 < score("x") < score("you idiot " * 10_000) < 1


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit >= 0.85 * sum(r.toxic for r in held)
    assert hit >= 0.85 * sum(r.predicted for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, ("zzyzx you " if i % 2 else "calm words ") + " ".join(f"{i}.{k}" for k in range(30))) for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(toxicity.held_out(F.col("doc_id")), F.lit(1)).otherwise(0).alias("toxic"))
    assert "zzyzx" not in toxicity.train(docs, labels).patterns
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    grammar = toxicity.train(docs, labels)
    assert any("zzyzx".startswith(p.rstrip("*")) for p in grammar.patterns)


def test_nulls_empty_and_clashes(spark):
    rows = [(1, None, 5.0), (1, "", 5.0), (None, "you idiot", 5.0), (2, "é" * 300_000, 5.0), (3, "idiot " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    out = toxicity.score(df, toxicity.seeds())
    assert out.columns == ["doc_id", "text", "toxicity", "toxic_clauses"]
    got = out.collect()
    assert got[0].toxicity == got[1].toxicity == got[3].toxicity < 0.3 <= got[2].toxicity < got[4].toxicity
    assert [len(r.toxic_clauses) for r in got] == [0, 0, 1, 0, 1]
    none = spark.createDataFrame([], "doc_id long, text string")
    grammar = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none, grammar).count() == 0


def test_composition_is_order_of_reading():
    """A composed machine writes what its parts write one after the other."""
    a, b = (toxicity.transducer(*row) for row in toxicity.RULES[:2])
    both = a.then(b)
    for symbols in (["negation", "insult", "word", "threat"], ["report", "insult", "negation", "insult"], ["insult", "quote", "threat", "quote"]):
        assert both.best(symbols) == b.best(a.best(symbols))
    assert toxicity.transducer("between", "quote", "reported", None).best(["insult", "quote", "insult", "quote", "threat"]) == ["insult", "quote", "insult/reported", "quote", "threat"]
    beside = toxicity.transducer("beside", "target", "aimed", 2)
    assert beside.best(["insult", "word", "target"]) == ["insult/aimed", "word", "target"]
    assert beside.best(["insult", "word", "word", "target"]) == ["insult", "word", "word", "target"]
    assert beside.best(["target", "word", "insult", "insult"]) == ["target", "word", "insult/aimed", "insult"]


def test_a_new_rule_is_a_new_row(monkeypatch):
    rules = (*toxicity.RULES[:3], ("after", "question", "asked", 2), toxicity.RULES[3])
    monkeypatch.setattr(toxicity, "RULES", rules)
    monkeypatch.setitem(toxicity.SEEDS, "question", "why")
    machine = toxicity.transducer(*rules[0])
    for row in rules[1:]:
        machine = machine.then(toxicity.transducer(*row))
    assert machine.best(["question", "insult", "target"]) == ["question", "insult/asked", "target"]


def test_few_labels(spark):
    """Held-out rows of a table with some fifty toxic labels; small classes of words are found by their beginnings."""
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted and r.toxic for r in rows) >= 0.7 * sum(r.toxic for r in rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.05 * sum(not r.toxic for r in rows)
