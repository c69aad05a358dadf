"""Readers, writers and reports."""

from pyspark.sql import functions as F

from leafquire.operators import checks, keyword
from leafquire.sources import tables as S


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", "d", "제목", ["가", "b"], 1, 2, None, None)], S.SCHEMAS["sections"])
    back = S.write_json(df, str(tmp_path / "s"))
    assert back.collect() == df.collect()
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("part-*"))
    assert "제목" in text and '"page_printed_start":null' in text
    (tmp_path / "gt.jsonl").write_text('{"id":"q1","answer_sections":["a"],"must_contain":[]}\n\n')
    assert S.read(spark, "ground_truth", str(tmp_path / "gt.jsonl"), "json").first().answer_sections == ["a"]
    assert S.path_array(S.path_json(df)).first().level_path == ["가", "b"]


def test_subset_rebuild(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int")
    df.write.partitionBy("doc_id").parquet(path)
    S.rebuild_docs(df.withColumn("v", F.lit(2)), path, ["b"])
    assert {r.doc_id: r.v for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 2}
    S.rebuild({"x": df}, path + "all")
    assert spark.read.parquet(path + "all/x").count() == 2


def test_only_new_texts_are_embedded(spark):
    chunks = spark.createDataFrame([("1", "d", "text", "old"), ("2", "d", "text", "new"), ("3", "d", "text", "new")], "chunk_id string, doc_id string, content_type string, text_for_embedding string")
    stored = chunks.where("chunk_id = '1'").select(S.digest("m").alias("digest"), F.array(F.lit(9.0).cast("float")).alias("embedding"))
    assert S.new_digests(chunks, stored, "m").count() == 1
    got = {r.chunk_id: r.embedding for r in S.vectors(chunks, stored, "m", lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert got == {"1": [9.0], "2": [3.0], "3": [3.0]}
    assert checks.misaligned(chunks, S.vectors(chunks, stored, "m", lambda texts: [[0.0]] * len(texts))).count() == 0


def test_bucketed_postings(spark):
    chunks = spark.createDataFrame([("1", "가나다")], "chunk_id string, text string")
    keyword.write_postings(keyword.postings(chunks), "postings_test", 2)
    assert spark.table("postings_test").count() == 2
    spark.sql("DROP TABLE postings_test")


def test_size_report(spark):
    rows = spark.createDataFrame([(v,) for v in [10, 20, 30, 60, 70, 80, 90, 100, 110, 400]], "size long")
    assert tuple(checks.size_report(rows).first()) == (10, 10, 75.0, 400, 400, 3)


def test_ground_truth(spark):
    cases = spark.createDataFrame([("q", "x", ["s1", "s9"], ["needle", "absent"]), ("r", "y", ["s2"], [])], "id string, type string, answer_sections array<string>, must_contain array<string>")
    sections = spark.createDataFrame([("s1",), ("s2",)], "section_id string")
    chunks = spark.createDataFrame([("s1-c00", "s1", "a needle")], "chunk_id string, section_id string, text string")
    problems = checks.ground_truth_problems(cases, sections, chunks)
    assert {(r.id, r.problem, r.detail) for r in problems.collect()} == {("q", "no such section", "s9"), ("r", "no chunks", "s2"), ("q", "missing text", "absent")}
    assert {r.type: (r.n_cases, r.n_problems) for r in checks.cases_by_type(cases, problems).collect()} == {"x": (1, 2), "y": (1, 1)}
