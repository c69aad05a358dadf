"""Reports on the built tables."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.functions import text as X
from leafquire.operators.layout import body_lines, contents_lines, footer_lines, in_ranges
from leafquire.sources.stage import staged

#: Shorter texts say nothing about coverage.
COVER_LEAST = 6
#: The least share of lines that a document's chunks must hold.
COVER_SHARE = 0.99


def summary(chunks: DataFrame) -> DataFrame:
    """Chunks by document and content type, with totals (nulls) by rollup."""
    return chunks.rollup("doc_id", "content_type").agg(F.count("*").alias("n_chunks"), F.countDistinct("section_id").alias("n_sections"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def heading_methods(headings: DataFrame) -> DataFrame:
    """Headings of each document by how they were matched; 'none' are failures."""
    return headings.groupBy("doc_id").pivot("method", ["exact", "prefix", "fuzzy", "none"]).count().na.fill(0, ["exact", "prefix", "fuzzy", "none"])


def page_numbers(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Footer numbers that equal the computed printed page, and those that do not."""
    number = F.regexp_extract(X.strip("text"), r"(?U)^[/\\]?\s*(\d{1,3})\s*[/\\]?$", 1)
    rows = footer_lines(lines).join(profiles.select("doc_id", "page_offset"), "doc_id").withColumn("number", number).where("number != ''")
    good = F.col("number").cast("int") == F.col("page_pdf") - F.col("page_offset")
    return rows.groupBy("doc_id").agg(F.count_if(good).alias("n_equal"), F.count_if(~good).alias("n_other"))


def coverage(lines: DataFrame, profiles: DataFrame, chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """Share of a document's body lines whose text stands in its chunks or titles.

    Contents pages and form appendices are left out, as are texts under six characters.
    Each document's text is held once: its lines meet it in one group.
    """
    rows = contents_lines(body_lines(lines), profiles, keep=False).join(profiles.select("doc_id", "page_offset", "form_ranges"), "doc_id")
    rows = rows.where(~in_ranges(F.col("page_pdf") - F.col("page_offset"), F.col("form_ranges")))
    rows = rows.select("doc_id", X.squash_cover(F.col("text")).alias("key")).where(F.length("key") >= COVER_LEAST)
    # Equal lines of a document are tested once and counted as often as they stand.
    keys = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    texts = chunks.select("doc_id", F.col("text").alias("t")).unionByName(headings.select("doc_id", F.col("title").alias("t")))
    schema = "doc_id string, n_lines long, n_found long"

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        whole = "\n".join(right.column("k").to_pylist())
        keys, counts = left.column("key").to_pylist(), left.column("n").to_pylist()
        found = sum(n for k, n in zip(keys, counts) if k in whole)
        rows = left.slice(0, 1)
        return pa.table({"doc_id": rows.column("doc_id"), "n_lines": pa.array([sum(counts)][: len(rows)], pa.int64()), "n_found": pa.array([found][: len(rows)], pa.int64())})

    squashed = texts.select("doc_id", X.squash_cover(F.col("t")).alias("k"))
    found = keys.groupBy("doc_id").cogroup(squashed.groupBy("doc_id")).applyInArrow(held, schema)
    return found.withColumn("share", F.col("n_found") / F.col("n_lines"))


def coverage_verdict(shares: DataFrame) -> DataFrame:
    """The worst document's share over all documents, and whether it passes; one row."""
    return shares.agg(F.count("*").alias("n_docs"), F.min("share").alias("least"), F.coalesce(F.min("share") >= COVER_SHARE, F.lit(True)).alias("passes"))


def size_report(sizes: DataFrame, value: str = "size") -> DataFrame:
    """Least, median, 90th, greatest, number, and number under 50, of one column.

    The 90th is the value at place ``min(int(0.9 n), n - 1)`` from 0. Sizes are counted
    by value and dealt by ranges of values; sums per range place each range, and
    running sums inside the ranges place each value, so no task orders all of them.
    """
    v = F.col(value).alias("v")
    counts = sizes.groupBy(v).agg(F.count("*").alias("c")).repartitionByRange("v")
    counts = staged(counts.withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy("part").agg(F.sum("c").alias("here"))  # one row a range
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("ahead"), F.sum("here").over(W.partitionBy()).alias("n"))
    inside = W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    upto = counts.withColumn("inside", F.sum("c").over(inside)).join(F.broadcast(parts), "part").withColumn("upto", F.col("ahead") + F.col("inside"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    total = F.col("n")
    return upto.groupBy("n").agg(
        F.min("v").alias("least"), ((at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2).alias("median"),
        at(F.least(F.floor(total * F.lit(0.9)), total - 1)).alias("p90"), F.max("v").alias("most"), F.sum(F.when(F.col("v") < 50, F.col("c")).otherwise(0)).alias("under_50"),
    )


def section_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("section_id").agg(F.sum("char_count").alias("size"))


def section_texts(chunks: DataFrame, separator: str = "\n") -> DataFrame:
    """Each section's chunk texts in the order of their ids as text."""
    parts = chunks.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("parts"))
    return parts.select("section_id", F.array_join(F.transform("parts", lambda p: p["text"]), separator).alias("text"))


def ground_truth_problems(cases: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(id, type, problem, detail)``: unknown answer sections, empty ones, missing strings.

    A string is looked for in the chunks of its answer sections, one by one. Only strings
    with a line break can lie across the seam of two chunks; for these alone the answer
    sections' texts are joined.
    """
    answers = cases.select("id", "type", F.posexplode("answer_sections").alias("n", "section_id"))
    unknown = answers.join(sections.select("section_id"), "section_id", "left_anti").select("id", "type", F.lit("no such section").alias("problem"), F.col("section_id").alias("detail"))
    known = answers.join(sections.select("section_id"), "section_id", "left_semi")
    empty = known.join(chunks.select("section_id").distinct(), "section_id", "left_anti").select("id", "type", F.lit("no chunks").alias("problem"), F.col("section_id").alias("detail"))
    needles = cases.select("id", "type", F.explode("must_contain").alias("needle"))
    split = F.coalesce(F.col("needle").contains("\n"), F.lit(False))
    asked = needles.where(~split).join(answers.select("id", "n", "section_id"), "id").select("section_id", "id", "needle").distinct()
    found = chunks.select("section_id", "text").join(asked, "section_id").where(F.col("text").contains(F.col("needle"))).select("id", "needle").distinct()
    across = answers.join(needles.where(split).select("id").distinct(), "id", "left_semi")
    texts = section_texts(chunks.join(across.select("section_id").distinct(), "section_id", "left_semi"))
    joined = across.join(texts, "section_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("parts"))
    joined = joined.select("id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    seen = needles.where(split).join(joined, "id").where(F.col("text").contains(F.col("needle"))).select("id", "needle").distinct()
    missing = needles.join(found.unionByName(seen), ["id", "needle"], "left_anti").select("id", "type", F.lit("missing text").alias("problem"), F.col("needle").alias("detail"))
    return unknown.unionByName(empty).unionByName(missing)


def cases_by_type(cases: DataFrame, problems: DataFrame) -> DataFrame:
    bad = problems.groupBy("type").agg(F.count("*").alias("n_problems"))
    return cases.groupBy("type").agg(F.count("*").alias("n_cases")).join(bad, "type", "left").na.fill(0, ["n_problems"])


def dangling(chunks: DataFrame, sections: DataFrame, refs: DataFrame) -> DataFrame:
    """Chunks without their section and citations without their chunk: none, if all is well."""
    a = chunks.join(sections.select("section_id"), "section_id", "left_anti").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    b = refs.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("ref").alias("kind"), F.col("chunk_id").alias("id"))
    return a.unionByName(b)


def misaligned(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector, and vectors without a chunk."""
    c, v = chunks.select("chunk_id", F.lit(1).alias("c")), vectors.select("chunk_id", F.lit(1).alias("v"))
    both = c.join(v, "chunk_id", "full_outer").where("c IS NULL OR v IS NULL")
    return both.select("chunk_id", F.when(F.col("v").isNull(), "no vector").otherwise("no chunk").alias("problem"))


def require_aligned(chunks: DataFrame, vectors: DataFrame) -> None:
    n = misaligned(chunks, vectors).count()
    if n:
        raise ValueError(f"{n} chunks and vectors do not match")
