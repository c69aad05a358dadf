"""Keyword and vector search, fusion, results, and context, on small tables."""

import random

from pyspark.sql import functions as F

from leafquire.operators import citations, context, keyword, search

BODIES = {"a": "aa aa aa bb", "b": "ab bc cd", "c": "AB bc xx yy zz", "d": "qq ab zz bc", "e": "zz", "f": "yy", "g": ""}


def chunk_table(spark, bodies=BODIES):
    return spark.createDataFrame([(k, f"s{k}", "doc", "text", t) for k, t in bodies.items()], "chunk_id string, section_id string, doc_id string, content_type string, text string")


def terms(spark, bodies):
    """Bodies whose words are the terms themselves."""
    rows = [(k, i, w.lower()) for k, t in bodies.items() for i, w in enumerate(t.split())]
    n = [(k, len(t.split())) for k, t in bodies.items()]
    return spark.createDataFrame(rows, "chunk_id string, pos int, gram string"), spark.createDataFrame(n, "chunk_id string, n int")


def score(spark, phrases):
    index, lengths = terms(spark, BODIES)
    p = spark.createDataFrame([("q", i, x) for i, x in enumerate(phrases)], "query_id string, phrase_no int, phrase array<string>")
    return {r.chunk_id: round(r.score, 6) for r in keyword.bm25(p, keyword.phrase_matches(p, index), lengths).collect()}


def test_bm25(spark):
    assert score(spark, [["aa", "aa"]]) == {"a": -1.743752}
    assert score(spark, [["ab", "bc"]]) == {"b": -0.738130, "c": -0.568723}
    assert score(spark, [["ab", "bc"], ["zz"]]) == {"c": -0.749999, "b": -0.738130, "e": -0.335086, "d": -0.204775}
    assert score(spark, [["ab", "bc"]] * 2)["b"] == -1.476261


def test_phrases_equal_a_plain_scan(spark):
    rng = random.Random(3)
    bodies = {f"k{i}": " ".join(rng.choice(["aa", "ab", "bc"]) for _ in range(rng.randint(0, 30))) for i in range(40)}
    index, _ = terms(spark, bodies)
    phrases = [["aa"], ["aa", "aa"], ["ab", "bc", "aa"], ["zz", "aa"]]
    p = spark.createDataFrame([("q", i, x) for i, x in enumerate(phrases)], "query_id string, phrase_no int, phrase array<string>")
    got = {(tuple(r.phrase), r.chunk_id): r.f for r in keyword.phrase_matches(p, index).collect()}
    want = {}
    for x in phrases:
        for k, t in bodies.items():
            w = t.split()
            n = sum(w[i : i + len(x)] == x for i in range(len(w)))
            if n:
                want[tuple(x), k] = n
    assert got == want


def test_filters_come_before_the_cut(spark):
    chunks = spark.createDataFrame([(f"c{i}", "s", "big" if i else "small", "text", "가나다 " * (i + 1)) for i in range(20)], "chunk_id string, section_id string, doc_id string, content_type string, text string")
    q = spark.createDataFrame([("1", "가나다", "small", None), ("2", "가나다", None, None), ("3", "", None, None), ("4", None, None, "table")], "query_id string, query string, doc_id string, content_type string")
    got = keyword.keyword_search(q, chunks, keyword.postings(chunks), keyword.lengths(chunks), k=3).collect()
    assert [(r.query_id, r.chunk_id) for r in got if r.query_id == "1"] == [("1", "c0")]
    assert sum(r.query_id == "2" for r in got) == 3 and len(got) == 4


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int")
    fused = search.fuse(ranked("abc"), ranked("bd")).orderBy("fused_rank")
    assert [(r.chunk_id, round(r.score, 6)) for r in fused.collect()] == [("b", 0.048652), ("a", 0.032787), ("c", 0.031746), ("d", 0.016129)]
    chunks = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("d", "s2")], "chunk_id string, section_id string")
    assert [(r["rank"], r.section_id, r.matched_chunk_id) for r in search.best_sections(fused, chunks, 2).orderBy("rank").collect()] == [(1, "s2", "b"), (2, "s1", "a")]


def test_vectors_and_hybrid(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0], "d1", "text"), ("y", [0.0, 2.0], "d1", "table"), ("z", [3.0, 3.0], "d2", "text"), ("o", [0.0, 0.0], "d2", "text")], "chunk_id string, embedding array<float>, doc_id string, content_type string")
    q = spark.createDataFrame([("1", "가나", None, None, [2.0, 0.1]), ("2", "가나", "d2", None, [1.0, 0.0]), ("3", "가나", None, None, None)], "query_id string, query string, doc_id string, content_type string, embedding array<float>")
    got = [(r.query_id, r.chunk_id, r["rank"]) for r in search.vector_search(q, v, 2).orderBy("query_id", "rank").collect()]
    assert got == [("1", "x", 1), ("1", "z", 2), ("2", "z", 1)]
    chunks = spark.createDataFrame([(c, f"s{c}", "d1", "text", "가나 다라") for c in "xyz"], "chunk_id string, section_id string, doc_id string, content_type string, text string")
    out = search.hybrid_search(q, chunks, keyword.postings(chunks), keyword.lengths(chunks), v)
    assert {r.query_id for r in out.where("keyword_only").collect()} == {"3"}
    assert search.vector_search(q.where("query_id = '3'"), v).count() == 0


def test_expansion_orders_ids_as_text(spark):
    chunks = spark.createDataFrame([("s-c100", "s", "B"), ("s-c11", "s", "C"), ("s-c10", "s", "A")], "chunk_id string, section_id string, text string")
    sections = spark.createDataFrame([("s", "d", "T", ["T"], 1, 2)], "section_id string, doc_id string, title string, level_path array<string>, page_printed_start int, page_printed_end int")
    results = spark.createDataFrame([("q", 1, "s"), ("q", 2, "gone")], "query_id string, rank int, section_id string")
    row = search.expand(results, sections, chunks).collect()
    assert [(r.text, r.citation) for r in row] == [("A\n\nB\n\nC", "p1~2")]


def test_windows_and_pages(spark):
    df = spark.createDataFrame([([1000] * 4, 1), ([9000, 1], 0), ([10, 10], 1)], "sizes array<int>, at int")
    got = [tuple(r.w) for r in df.select(context.evidence_window(F.col("sizes"), F.col("at"), 2500).alias("w")).collect()]
    assert got == [(1, 2, True), (0, 0, True), (0, 1, False)]
    chunks = spark.createDataFrame([("s", 0, 7000), ("s", 1, 100)], "section_id string, at int, chars int")
    page = context.page_section(chunks, spark.createDataFrame([("s", 0), ("s", 1)], "section_id string, offset int")).orderBy("offset").collect()
    assert [(r.n_chunks, r.next_offset) for r in page] == [(1, 1), (1, None)]


def test_citation_verdicts(spark):
    df = spark.createDataFrame([("r", ["[v2-s013]", " x", "x"], ["v2-s013"]), ("n", None, None)], "run_id string, citations array<string>, retrieved array<string>")
    got = {r.run_id: (r.invented, r.verdict) for r in context.check_citations(df).collect()}
    assert got == {"r": (["x", "x"], "insufficient"), "n": ([], "sufficient")}


def test_evidence_merge(spark):
    row = lambda xs: spark.createDataFrame([("r", s, i) for i, s in enumerate(xs)], "run_id string, section_id string, place int")
    got = context.merge_evidence(row("abc"), row("cde"), 4).orderBy("merged_place")
    assert [r.section_id for r in got.collect()] == list("cdea")


def test_citation_lookup(spark):
    refs = spark.createDataFrame([(f"c{i}", "법" if i % 2 else "", "별표7") for i in range(8)] * 2, "chunk_id string, law string, target string")
    chunks = spark.createDataFrame([(f"c{i}", "s", i) for i in range(8)], "chunk_id string, section_id string, page_printed_start int")
    sections = spark.createDataFrame([("s", "t")], "section_id string, title string")
    asked = spark.createDataFrame([(1, "별표 7", None), (2, "별표7", "법")], "ask_id int, target string, law string")
    got = sorted((r.ask_id, r.chunk_id, r.n_total) for r in citations.lookup(asked, refs, chunks, sections, 3).collect())
    assert got == [(1, "c0", 8), (1, "c1", 8), (1, "c2", 8), (2, "c1", 4), (2, "c3", 4), (2, "c5", 4)]
