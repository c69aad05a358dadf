"""The three jobs from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators import blocks, citations, forms, keyword, layout, search
from leafquire.operators.ranges import numbered, rows_of
from leafquire.sources.stage import staged


def build(lines: DataFrame, profiles: DataFrame, raw_tables: DataFrame, entries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Layout lines to sections, chunks and citations.

    ``raw_tables`` has the detected tables (``doc_id, page_pdf, table_no, bbox, rows``).
    Without ``entries`` the contents pages are read.
    """
    entries = layout.contents_entries(lines, profiles) if entries is None else entries
    body = layout.body_rows(lines)
    headings = staged(layout.pin_headings(entries.where("kind = 'section'"), body, profiles))
    return assemble(body, profiles, raw_tables, headings)


def assemble(lines: DataFrame, profiles: DataFrame, raw_tables: DataFrame, headings: DataFrame) -> dict[str, DataFrame]:
    """The build from pinned headings on."""
    body = layout.body_rows(lines)
    gated = numbered(blocks.gate_tables(raw_tables), "_box")
    tables = staged(blocks.table_captions(gated.drop("rows"), body))
    ordered = layout.section_spans(headings, profiles)
    toc = profiles.select("doc_id", F.explode("toc_pdf_pages").alias("page_pdf"), F.lit(True).alias("toc"))
    middle = tables.withColumn("mid", (F.col("bbox.y0") + F.col("bbox.y1")) / 2)
    boxes = layout.assign(middle, ordered, "mid").join(toc, ["doc_id", "page_pdf"], "left").where("place > 0 OR toc IS NULL").drop("toc", "mid")
    boxes = staged(boxes)
    # A line with more letters than any caption is none, so its text need not come along.
    key, longest = X.squash(F.col("text")), boxes.agg(F.max(F.length(X.squash(F.col("caption"))))).first()[0] or 0
    thin = body.select("doc_id", "page_pdf", "line_no", "y0", "x0", "_row", "_n", F.when(F.length(key) <= longest, key).alias("_key"))
    placed = layout.assign(thin, ordered).join(toc, ["doc_id", "page_pdf"], "left").where("place > 0 OR toc IS NULL").drop("toc")
    inside = blocks.lines_inside(body.select("doc_id", "page_pdf", "y0", "_row"), boxes)
    residual = blocks.residual_lines(gated, rows_of(body, inside)).select("_box", "residual")
    heads, members = blocks.outline(blocks.lines_outside(placed, boxes), boxes.join(residual, "_box"), body, gated)
    # Documents without headings have no front matter either.
    fronts = heads.where("place = 0").join(headings.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct()
    spans = layout.section_spans(layout.level_paths(headings), profiles, fronts).where("kept")
    spans = staged(spans)
    about = profiles.select("doc_id", "short_title", "page_offset")
    first = headings.groupBy("doc_id").agg(F.min("page_pdf").alias("end_page"))
    front = fronts.join(first, "doc_id").select("doc_id", F.lit(0).alias("place"), F.concat("doc_id", F.lit("-front")).alias("section_id"), F.lit(P.FRONT).alias("title"), F.array(F.lit(P.FRONT)).alias("level_path"), F.lit(1).alias("page_pdf"), "end_page")
    every = front.unionByName(spans.select("doc_id", "place", "section_id", "title", "level_path", "page_pdf", "end_page")).join(about, "doc_id")
    printed = lambda c: X.printed_page(F.col(c), F.col("page_offset"))
    sections = every.select(
        "section_id", "doc_id", "title", "level_path", F.col("page_pdf").alias("page_pdf_start"), F.col("end_page").alias("page_pdf_end"),
        printed("page_pdf").alias("page_printed_start"), printed("end_page").alias("page_printed_end"),
    )
    full = heads.join(every.select("doc_id", "place", "section_id", "level_path", "short_title", "page_offset"), ["doc_id", "place"])
    chunks = blocks.with_texts(full, members, body).select(
        F.format_string("%s-c%02d", "section_id", "number").alias("chunk_id"), "section_id", "doc_id", "content_type", "text",
        X.embedding_text(F.col("short_title"), F.col("level_path"), F.col("text")).alias("text_for_embedding"),
        F.col("page_start").alias("page_pdf_start"), F.col("page_end").alias("page_pdf_end"), printed("page_start").alias("page_printed_start"), printed("page_end").alias("page_printed_end"),
        F.length("text").alias("char_count"), "caption",
    )
    listed = staged(forms.form_chunks(forms.catalog(rows_of(body, forms.form_rows(body, profiles)), profiles), profiles))
    chunks = chunks.unionByName(listed)
    sections = sections.unionByName(forms.form_sections(listed).select(*sections.columns))
    refs = citations.extract(chunks.join(profiles.select("doc_id", "alias_map"), "doc_id"), F.col("alias_map"))
    return {"sections": sections, "chunks": chunks, "refs": refs, "headings": headings}


def index(chunks: DataFrame) -> dict[str, DataFrame]:
    """Chunks to postings and lengths."""
    return {"postings": keyword.postings(chunks), "lengths": keyword.lengths(chunks)}


def answer(queries: DataFrame, tables: dict[str, DataFrame], vectors: DataFrame, limit: int = 5) -> DataFrame:
    """Queries to sections with their whole text; without stored postings the chunks are searched."""
    found = staged(search.hybrid_search(queries, tables["chunks"], tables.get("postings"), tables.get("lengths"), vectors, limit))
    return search.expand(found, tables["sections"], tables["chunks"])
