"""Column functions and citations, on small rows with expected values."""

import pytest
from pyspark.sql import functions as F

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators import citations


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_terms(spark):
    assert values(spark, ["기술료율 2.5% A", "", None], X.grams) == [["기술", "술료", "료율", "2", "5", "a"], [], []]
    assert values(spark, ["중소기업 기술료율 얼마야?", "얼마야"], X.content_words) == [["중소기업", "기술료율"], ["얼마야"]]


def test_strings(spark):
    assert values(spark, ["제1장 총-칙 (A)"], X.match_key) == ["제1장총칙A"]
    assert values(spark, ["제 1 장 총칙", "Ⅱ. 개요", "3. 목적", "(2) 정의", "[참고 1] 표", "그냥"], X.strip_number) == ["총칙", "개요", "목적", "정의", "표", "그냥"]
    assert values(spark, ["총 칙 ····"], X.normalize) == ["총칙"]
    assert values(spark, [None, "  a \n b　"], X.clean_cell) == ["", "a b"]
    assert values(spark, ["a | b-c"], X.squash_cover) == ["abc"]
    assert values(spark, ["x" * 5 + "  y", "ab"], lambda c: X.truncate(c, 6)["text"]) == ["xxxxx", "ab"]
    assert values(spark, ["a" * 17, ""], X.tokens) == [20, 0]


def test_levels(spark):
    titles = ["제1장 총칙", "제 2 절 x", "1. 목적", "(1) 정의", "참고 1", "없음", "제1장총칙"]
    assert values(spark, titles, lambda c: X.level_of(c, P.LEVELS["chapter_section"])) == [1, 2, 3, 4, 5, None, None]


@pytest.mark.parametrize("pages, want", [((3, 3), "p3"), ((3, 5), "p3~5"), ((None, 2), "머리말")])
def test_citation(spark, pages, want):
    df = spark.createDataFrame([pages], "a int, b int")
    assert df.select(X.citation(F.col("a"), F.col("b"))).first()[0] == want


def test_markdown_and_unit(spark):
    df = spark.createDataFrame([([["h", "i"], ["x"]], ["rest"], [3.0, 4.0])], "rows array<array<string>>, rest array<string>, v array<double>")
    row = df.select(X.markdown(F.col("rows"), F.col("rest")).alias("m"), X.unit(F.col("v")).alias("u")).first()
    assert row.m == "| h | i |\n|---|---|\n| x |  |\n\nrest"
    assert row.u == [0.6, 0.8]


def test_citations(spark):
    text = "시행령 제59조제2항 및 법 제32조 제1항, 혁신법 제32조제1항, 별표 7, 제5조"
    df = spark.createDataFrame([("c", "d", text), ("e", "d", "없음"), ("n", "d", None)], "chunk_id string, doc_id string, text string")
    aliases = F.create_map(*[F.lit(x) for kv in P.ALIASES.items() for x in kv])
    got = {(r.law, r.target): r.raw for r in citations.extract(df, aliases).collect()}
    assert got == {("국가연구개발혁신법 시행령", "제59조제2항"): "시행령 제59조제2항", ("국가연구개발혁신법", "제32조제1항"): "법 제32조 제1항", ("", "별표7"): "별표 7"}
