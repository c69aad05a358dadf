"""Catalogs of forms in appendices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators.layout import in_ranges, reading_order

COVER_LINES = 3


def covers(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(doc_id, appendix_no, page_pdf, appendix_title, last_printed)``: cover pages of appendices.

    Only the first three lines of a page in a form range can make it a cover. Its title
    is the rest of that line and the later lines of the same size. ``last_printed`` is where the
    appendix ends: before the next cover, or with the last range.
    """
    printed = F.col("page_pdf") - F.col("page_offset")
    rows = lines.join(profiles.select("doc_id", "page_offset", "form_ranges"), "doc_id").withColumn("printed", printed).where(in_ranges(F.col("printed"), F.col("form_ranges")))
    rows = rows.withColumn("t", X.strip("text")).withColumn("n", F.row_number().over(reading_order("doc_id", "page_pdf")))
    page = W.partitionBy("doc_id", "page_pdf")
    hit = F.when((F.col("n") <= COVER_LINES) & F.col("t").rlike(P.COVER), F.struct("n", "t", "size"))
    rows = rows.withColumn("cover", F.min(hit).over(page)).where("cover IS NOT NULL")
    later = (F.col("n") > F.col("cover.n")) & (F.abs(F.col("size") - F.col("cover.size")) < 0.5)
    found = rows.groupBy("doc_id", "page_pdf", "printed", "cover", F.array_max(F.transform("form_ranges", lambda r: r["hi"])).alias("last")).agg(
        F.array_sort(F.collect_list(F.when(later, F.struct("n", "t")))).alias("rest")
    )
    title = X.strip(F.array_join(F.concat(F.array(X.strip(F.regexp_replace("cover.t", P.COVER, ""))), F.transform("rest", lambda r: r["t"])), " "))
    number = F.regexp_extract("cover.t", P.COVER, 1).cast("int")
    following = F.lead("printed").over(W.partitionBy("doc_id").orderBy("page_pdf")) - 1
    return found.select("doc_id", number.alias("appendix_no"), "page_pdf", title.alias("appendix_title"), F.coalesce(following, F.col("last")).alias("last_printed"))


def form_rows(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """``_row`` of the lines on pages in a form range: a catalog needs no others."""
    rows = lines.select("doc_id", "page_pdf", "_row").join(profiles.select("doc_id", "page_offset", "form_ranges"), "doc_id")
    return rows.where(in_ranges(F.col("page_pdf") - F.col("page_offset"), F.col("form_ranges"))).select("_row")


def catalog(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(doc_id, appendix_no, appendix_title, form_no, name, page_start, page_end, form_order)``.

    A form is a cover line with leader dots and a page whose head begins with a form
    number; empty and deleted names are left out. It ends before the next form begins,
    the last one where its appendix ends, and never before its start.
    """
    rows = lines.join(covers(lines, profiles), ["doc_id", "page_pdf"]).withColumn("t", X.strip("text")).where(F.col("t").rlike(P.TERMINATOR))
    head = X.strip(F.get(F.split("t", P.TERMINATOR, 2), F.lit(0)))
    rows = rows.withColumn("head", head).where(F.col("head").rlike(P.FORM_NO))
    rows = rows.withColumn("name", X.strip(F.regexp_replace("head", P.FORM_NO, ""))).where((F.col("name") != "") & (F.col("name") != P.DELETED))
    rows = rows.withColumn("form_no", X.squash(F.regexp_extract("head", P.FORM_NO, 1))).withColumn("page_start", F.regexp_extract("t", P.TERMINATOR, 1).cast("int"))
    order = reading_order("doc_id", "page_pdf")
    end = F.coalesce(F.lead("page_start").over(order) - 1, F.col("last_printed"))
    return rows.select(
        "doc_id", "appendix_no", "appendix_title", "form_no", "name", "page_start", F.greatest("page_start", end).alias("page_end"),
        F.struct("page_pdf", F.row_number().over(order).alias("n")).alias("form_order"),
    )


def form_chunks(forms: DataFrame, profiles: DataFrame) -> DataFrame:
    """Chunks of the content type ``form_index``, numbered with three digits."""
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("form_order")) - 1
    body = X.form_text(F.col("name"), F.col("appendix_title"), F.col("form_no"), F.col("page_start"), F.col("page_end"))
    rows = forms.join(profiles.select("doc_id", "short_title", "page_offset"), "doc_id").withColumn("number", number).withColumn("text", body)
    section = F.concat("doc_id", F.lit("-forms"))
    return rows.select(
        F.format_string("%s-c%03d", section, "number").alias("chunk_id"), section.alias("section_id"), "doc_id", F.lit("form_index").alias("content_type"), "text",
        F.concat(F.lit("["), "short_title", F.lit(f"] {P.FORMS}\n"), "text").alias("text_for_embedding"),
        (F.col("page_start") + F.col("page_offset")).alias("page_pdf_start"), (F.col("page_end") + F.col("page_offset")).alias("page_pdf_end"),
        F.col("page_start").alias("page_printed_start"), F.col("page_end").alias("page_printed_end"), F.length("text").alias("char_count"), F.col("name").alias("caption"),
    )


def form_sections(chunks: DataFrame) -> DataFrame:
    """One section for each document's form chunks, over all their pages."""
    spans = chunks.groupBy("section_id", "doc_id").agg(*[f(c).alias(c) for f, c in (
        (F.min, "page_pdf_start"), (F.max, "page_pdf_end"), (F.min, "page_printed_start"), (F.max, "page_printed_end"))])
    return spans.withColumn("title", F.lit(P.FORMS)).withColumn("level_path", F.array(F.lit(P.FORMS)))


def against_declared(forms: DataFrame) -> DataFrame:
    """Forms per appendix and the count that its title declares (null: none declared)."""
    declared = F.regexp_extract("appendix_title", P.DECLARED, 1)
    counts = forms.groupBy("doc_id", "appendix_no", "appendix_title").agg(F.count("*").alias("n_forms"))
    return counts.withColumn("declared", F.when(declared != "", declared.cast("int"))).withColumn("agrees", F.col("n_forms") == F.col("declared"))
