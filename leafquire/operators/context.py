"""What of the results is shown: evidence windows, pages of sections, merged evidence, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.functions import patterns as P
from leafquire.functions import text as X


def evidence_window(sizes: Column, matched: Column, limit: int = P.EVIDENCE_CHARS) -> Column:
    """``struct<lo, hi, partial>`` (places from 0, both included) around a matched chunk.

    It grows to the next chunk, then to the one before, in turn, as long as a step fits
    the limit; a side that does not fit is closed. The matched chunk always stays.
    """
    n = F.size(sizes)
    at = lambda i: F.get(sizes, i)
    start = F.struct(matched.cast("int").alias("lo"), matched.cast("int").alias("hi"), at(matched.cast("int")).cast("long").alias("sum"), F.lit(False).alias("stop"))

    def step(s: Column, _: Column) -> Column:
        up = (s["hi"] + 1 < n) & (s["sum"] + at(s["hi"] + 1) <= limit)
        grown = F.when(up, s["sum"] + at(s["hi"] + 1)).otherwise(s["sum"])
        down = (s["lo"] > 0) & (grown + at(s["lo"] - 1) <= limit)
        moved = F.struct(
            F.when(down, s["lo"] - 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"] + 1).otherwise(s["hi"]).alias("hi"),
            F.when(down, grown + at(s["lo"] - 1)).otherwise(grown).alias("sum"), (~(up | down)).alias("stop"),
        )
        return F.when(s["stop"], s).otherwise(moved)

    return F.aggregate(sizes, start, step, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), ((s["lo"] > 0) | (s["hi"] < n - 1)).alias("partial")))


def page_section(chunks: DataFrame, offsets: DataFrame, limit: int = P.SECTION_CHARS) -> DataFrame:
    """The chunks of a section from ``offset`` while they fit, at least one; and where to go on.

    ``chunks(section_id, at, chars)`` and ``offsets(section_id, offset)``; ``next_offset``
    is null at the end.
    """
    rows = chunks.join(offsets, "section_id").where("at >= offset")
    order = W.partitionBy("section_id", "offset").orderBy("at")
    rows = rows.withColumn("sum", F.sum("chars").over(order)).withColumn("last", F.max("at").over(W.partitionBy("section_id", "offset")))
    shown = rows.where((F.col("sum") <= limit) | (F.col("at") == F.col("offset")))
    return shown.groupBy("section_id", "offset", "last").agg(F.max("at").alias("to"), F.count("*").alias("n_chunks")).select(
        "section_id", "offset", "n_chunks", F.when(F.col("to") < F.col("last"), F.col("to") + 1).alias("next_offset")
    )


def merge_evidence(old: DataFrame, new: DataFrame, most: int = P.EVIDENCE_SECTIONS) -> DataFrame:
    """New before old, each section of a run once by its first place, at most ``most``."""
    both = new.withColumn("age", F.lit(0)).unionByName(old.withColumn("age", F.lit(1)))
    first = W.partitionBy("run_id", "section_id").orderBy("age", "place")
    once = both.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    place = F.row_number().over(W.partitionBy("run_id").orderBy("age", "place"))
    return once.withColumn("merged_place", place).where(F.col("merged_place") <= most)


def check_citations(runs: DataFrame) -> DataFrame:
    """Add ``invented`` (cited ids that were not retrieved, repeats kept) and ``verdict``."""
    cited = F.transform(F.coalesce("citations", F.array().cast("array<string>")), lambda c: X.strip(F.translate(c, "[]", "")))
    invented = F.filter(cited, lambda c: ~F.array_contains(F.coalesce(F.col("retrieved"), F.array().cast("array<string>")), c))
    return runs.withColumn("invented", invented).withColumn("verdict", F.when(F.size("invented") > 0, "insufficient").otherwise("sufficient"))


def next_step(verdict: Column, complexity: Column, attempts: Column, most: int = 2) -> Column:
    """Where a run goes: on to the end, back to retrieval, or up to a person."""
    return F.when(verdict == "sufficient", "done").when((complexity == "simple") | (attempts >= most), "escalate").otherwise("retrieve")


def usage(runs: DataFrame) -> DataFrame:
    """Tokens and calls of each run."""
    return runs.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "calls")])


def result_text(results: DataFrame, limit: int = P.SNIPPET_CHARS) -> DataFrame:
    """One text for each query: path, source, id and body of each result, by rank."""
    body = X.truncate(F.col("text"), limit)
    one = F.concat_ws("\n", F.array_join("level_path", " > "), F.concat(F.lit("("), "doc_id", F.lit(", "), "citation", F.lit(")")), F.concat(F.lit("["), "section_id", F.lit("]")), body["text"])
    joined = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))).alias("parts"), F.first("keyword_only").alias("keyword_only"))
    text = F.array_join(F.transform("parts", lambda p: p["t"]), "\n---\n")
    return joined.select("query_id", F.when(F.col("keyword_only"), F.concat(F.lit("(keyword search only)\n"), text)).otherwise(text).alias("text"))
