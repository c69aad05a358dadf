"""Queries that take whole texts, against plain Python over small folders."""

import math
import re

from leafquire import catalog

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma upsilon omega common".split()


def grams(word):
    return [word] if len(word) < 2 else [word[i : i + 2] for i in range(len(word) - 1)]


def folder(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_keyword_search_takes_whole_passages(spark, tmp_path):
    texts = {i: " ".join(WORDS[(i * j) % 16] for j in range(i % 7 + 1)) for i in range(24)} | {30: "Omega omega", 31: None, 32: "sig ma"}
    asked = {1: " ".join(WORDS), 2: "alpha beta " * 4 + "Omega sigma kappa", 5: "nothing here fits at all but upsilon"}
    sf = folder(
        spark, tmp_path, documents=([(i, t, "en" if i % 2 else "fr", f"src{i % 3}") for i, t in texts.items()], "doc_id long, text string, lang string, source string"),
        benchmark=(list(asked.items()), "item_id long, text string"))
    held = {i: [g for w in re.findall("[0-9a-z]+", (t or "").lower()) for g in grams(w)] for i, t in texts.items()}
    mean = sum(map(len, held.values())) / len(held)

    def times(phrase, gs):
        return sum(gs[i : i + len(phrase)] == phrase for i in range(len(gs) - len(phrase) + 1))

    want = {}
    for q, text in asked.items():
        score = {}
        for w in re.findall("[0-9a-z]+", text.lower()):
            f = {i: n for i, gs in held.items() if (n := times(grams(w), gs))}
            idf = math.log((len(held) - len(f) + 0.5) / (len(f) + 0.5))
            for i, n in f.items():
                score[i] = score.get(i, 0) - (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(held[i]) / mean))
        kept = [i for i in score if (q % 5 or i % 3 == 1) and (q % 3 or i % 2)]
        want |= {(str(q), str(i)): round(score[i], 6) for i in kept}
    got = {(r.query_id, r.chunk_id): r.score for r in catalog.QUERIES["keyword_search"](spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert any(k[0] == "2" and k[1] == "30" for k in got)  # only a later word of the passage stands there


def test_every_citation_is_checked_against_the_whole_turn(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    turns = [(1, 0, "user", long), (1, 1, "assistant", "w0 w1 w2 w59 made [w58] up"), (2, 0, "user", "a b"), (2, 1, "assistant", " b a  b a "), (3, 0, "user", None), (3, 1, "assistant", "x")]
    sf = folder(spark, tmp_path, conversations=(turns, "conv_id long, turn int, role string, text string"))
    got = {r.run_id: (r.invented, r.verdict, r.step) for r in catalog.QUERIES["invented_citations"](spark, sf).collect()}
    assert got == {"1": ("made up", "insufficient", "escalate"), "2": ("", "sufficient", "done"), "3": ("x", "insufficient", "escalate")}
