"""Tables and lines of sections, and the chunks that they make."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators.ranges import counted_before, dealt, numbered, packed, rows_of
from leafquire.sources.stage import staged


def fill_merged(cells: DataFrame) -> DataFrame:
    """``cells(table_id, r, c, value)``: an empty cell takes the filled cell above it.

    A row that is too short for a column breaks that column's chain.
    """
    column = W.partitionBy("table_id", "c").orderBy("r")
    broken = (F.col("r") - F.coalesce(F.lag("r").over(column), F.col("r") - 1) > 1).cast("int")
    runs = cells.withColumn("run", broken)
    runs = runs.withColumn("run", F.sum("run").over(column.rowsBetween(W.unboundedPreceding, 0)))
    above = W.partitionBy("table_id", "c", "run").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    filled = F.last(F.when(F.coalesce("value", F.lit("")) != "", F.col("value")), ignorenulls=True).over(above)
    return runs.withColumn("value", F.coalesce(filled, F.lit(""))).drop("run")


def gate_tables(tables: DataFrame) -> DataFrame:
    """Tables worth keeping, with clean cells and their ``kind``.

    Rows without text go first. At least two rows must be left. Up to five rows with an
    equals sign and under 400 characters are a formula. Others must not be over 60 % empty,
    nor hold over half of their text in one cell.
    """
    rows = F.filter(F.transform("rows", lambda r: F.transform(r, X.clean_cell)), lambda r: F.exists(r, lambda c: c != ""))
    # Behind explode the cells are cleaned once, not anew in each condition pushed down to the scan.
    out = tables.withColumn("rows", F.explode(F.array(rows))).where(F.size("rows") >= 2)
    cells = F.flatten("rows")
    joined = F.array_join(cells, " ")
    total = F.aggregate(cells, F.lit(0), lambda s, c: s + F.length(c))
    longest = F.array_max(F.transform(cells, F.length))
    empty = F.size(F.filter(cells, lambda c: c == "")) / F.size(cells)
    formula = (F.size("rows") <= 5) & joined.contains("=") & (F.length(joined) < 400)
    out = out.withColumn("kind", F.when(formula, "formula").otherwise("table"))
    return out.where((F.col("kind") == "formula") | ((empty <= 0.6) & (longest / total <= 0.5)))


def table_captions(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``caption``: the nearest line up to 45 above that looks like one; of equals the later."""
    near = tables.select("doc_id", "page_pdf", "table_no", F.col("bbox.y0").alias("top")).join(
        lines.select("doc_id", "page_pdf", "y0", "x0", "line_no", X.strip("text").alias("t"), F.coalesce("bold", F.lit(False)).alias("bold")), ["doc_id", "page_pdf"]
    )
    gap = F.col("top") - F.col("y0")
    fits = (gap > 0) & (gap <= P.CAPTION_GAP) & (F.col("t").rlike(P.CAPTION) | (F.col("bold") & (F.length("t") <= 60)))
    best = near.where(fits).groupBy("doc_id", "page_pdf", "table_no").agg(
        F.max_by("t", F.struct((-gap).alias("g"), F.bround("y0", 1).alias("y"), "x0", "line_no")).alias("caption")
    )
    return tables.drop("caption").join(best, ["doc_id", "page_pdf", "table_no"], "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def residual_lines(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``residual``: lines inside a table whose text its cells do not hold."""
    inside = lines.join(tables.select("doc_id", "page_pdf", "table_no", "bbox", X.squash(F.array_join(F.flatten("rows"), " ")).alias("held")), ["doc_id", "page_pdf"])
    key = X.squash(F.col("text"))
    inside = inside.where(F.col("y0").between(F.col("bbox.y0") - 2, F.col("bbox.y1") + 2) & (F.length(key) >= 2) & ~F.col("held").contains(key))
    order = F.struct(F.bround("y0", 1).alias("y"), "x0", "line_no", X.strip("text").alias("t"))
    found = inside.groupBy("doc_id", "page_pdf", "table_no").agg(F.array_sort(F.collect_list(order)).alias("parts"))
    found = found.select("doc_id", "page_pdf", "table_no", F.transform("parts", lambda p: p["t"]).alias("residual"))
    none = F.array().cast("array<string>")
    out = tables.drop("residual").join(found, ["doc_id", "page_pdf", "table_no"], "left")
    return out.withColumn("residual", F.when(F.col("kind") == "formula", none).otherwise(F.coalesce("residual", none)))


def lines_inside(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """``_row`` of the lines that stand inside a table, for each such table."""
    boxes = tables.select("doc_id", "page_pdf", F.col("bbox.y0").alias("_top"), F.col("bbox.y1").alias("_bottom"))
    return lines.join(boxes, ["doc_id", "page_pdf"]).where(F.col("y0").between(F.col("_top") - 2, F.col("_bottom") + 2)).select("_row")


def lines_outside(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines that no table of the same section and page covers or claims as its caption.

    Both sides have ``place``, the section they belong to. Lines may have ``_key`` in place of ``text``.
    """
    keys = ["doc_id", "place", "page_pdf"]
    boxes = tables.select(*keys, F.col("bbox.y0").alias("top"), F.col("bbox.y1").alias("bottom"))
    covered = [lines[k] == boxes[k] for k in keys] + [lines["y0"].between(boxes["top"] - 2, boxes["bottom"] + 2)]
    left = lines.join(boxes, covered, "left_anti")
    left = left if "_key" in lines.columns else left.withColumn("_key", X.squash(F.col("text")))
    claimed = tables.where("caption != ''").select(*keys, X.squash(F.col("caption")).alias("_key"))
    return left.join(claimed, [*keys, "_key"], "left_anti").drop("_key")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _greedy(sizes: pd.Series, limit: pd.Series) -> pd.Series:
    out = []
    for row, most in zip(sizes, limit):
        groups, total, group = [], 0, 0
        for n in [] if row is None else row.tolist():
            if groups and total + n > most:
                group, total = group + 1, 0
            total += n
            groups.append(group)
        out.append(groups)
    return pd.Series(out, dtype=object)


def greedy(sizes: Column, limit: int) -> Column:
    """The group of each of an array's sizes: a new one starts where the sum would pass ``limit``.

    One element alone may be larger than the limit. Linear in the array, which no
    built-in is: they would copy the groups so far at each step.
    """
    return _greedy(F.transform(sizes, lambda n: n.cast("int")), F.lit(limit))


def pack_lines(lines: DataFrame, by: list[str], order: list[str], limit: int = P.CHUNK_CHARS) -> DataFrame:
    """Lines of each ``by`` in ``order``, packed into texts of about ``limit`` characters.

    Columns: ``by``, ``run`` from 0, ``text`` (lines joined by line breaks), and
    ``page_start``, ``page_end``. Runs of white space alone are dropped. A ``by`` with many
    lines is many tasks; only the lines of one text stand in one row.
    """
    text = X.strip(F.coalesce("text", F.lit("")))
    rows = lines.select(*by, *[c for c in order if c not in by], F.col("page_pdf").alias("_page"), text.alias("_t")).withColumn("_n", F.length("_t"))
    runs = packed(rows, by, [*order, "_page", "_t"], "_n", limit)
    grouped = runs.groupBy(*by, "run").agg(F.array_sort(F.collect_list(F.struct(*order, "_page", "_t"))).alias("parts"), F.min("_page").alias("page_start"), F.max("_page").alias("page_end"))
    out = grouped.withColumn("text", F.array_join(F.transform("parts", lambda p: p["_t"]), "\n")).where(X.strip("text") != "")
    return out.select(*by, "run", "text", "page_start", "page_end")


def table_parts(tables: DataFrame, limit: int = P.TABLE_CHARS) -> DataFrame:
    """Add ``part`` and ``text``: a table as markdown, long ones in parts that repeat the head.

    Formulas are one line per row and never split. Split tables lose their residual lines.
    """
    rows = F.col("rows")
    formula = F.array_join(F.transform(rows, lambda r: F.get(r, F.lit(0))), "\n")
    width = F.col("_width")
    whole = F.when(F.col("kind") == "formula", formula).otherwise(X.markdown(rows, F.col("residual"), width))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    # Behind explode the width is found once, not anew for each row.
    out = tables.withColumn("_width", F.explode(F.array(F.array_max(F.transform(rows, F.size))))).withColumn("whole", whole).withColumn("lines", F.transform(rows, line))
    body = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    out = out.withColumn("body", body).withColumn("groups", greedy(F.transform("body", F.length), limit))
    head = F.concat(F.get("lines", F.lit(0)), F.lit("\n|"), F.repeat(F.lit("---|"), width))
    split = (F.length("whole") > limit) & (F.col("kind") != "formula")
    # Each part is a slice from where its group begins to where the next one does.
    begins = F.filter(F.sequence(F.lit(0), F.size("groups") - 1), lambda i: (i == 0) | (F.get("groups", i) != F.get("groups", i - 1)))
    out = out.withColumn("begins", F.when(F.size("groups") > 0, begins).otherwise(F.array(F.lit(0))))
    ends = lambda i: F.coalesce(F.get("begins", i + 1), F.size("body"))
    parts = F.transform("begins", lambda b, i: F.concat(head, F.lit("\n"), F.array_join(F.slice("body", b + 1, ends(i) - b), "\n")))
    return out.withColumn("_parts", F.when(split, parts).otherwise(F.array("whole"))).select("*", F.posexplode("_parts").alias("part", "text")).drop("_width", "whole", "lines", "body", "groups", "begins", "_parts")


#: Texts meet in blocks of this many lines, as a power of two: a chunk's lines are mostly in one.
BLOCK_BITS = 12


def emit(lines: DataFrame, tables: DataFrame, limit: int = P.CHUNK_CHARS, lead_in: int = P.LEAD_IN_CHARS) -> DataFrame:
    """Chunks of each ``(doc_id, place)``: ``number, content_type, text, page_start, page_end, caption``.

    In reading order, a table before a line at the same height. Lines since the last
    table that come to under ``lead_in`` characters join the next table's first part
    after its caption; longer ones, and those after the last table, are packed as text.
    """
    body = numbered(lines.withColumn("_n", F.length(X.strip(F.coalesce("text", F.lit(""))))), "_row", compression="zstd")
    cells = numbered(tables, "_box", compression="zstd")
    heads, members = outline(body.drop("text"), cells.drop("rows"), body, cells, limit, lead_in)
    return with_texts(heads, members, body)


def outline(lines: DataFrame, tables: DataFrame, body: DataFrame, cells: DataFrame, limit: int = P.CHUNK_CHARS, lead_in: int = P.LEAD_IN_CHARS) -> tuple[DataFrame, DataFrame]:
    """The chunks of ``emit`` before their texts are put together, and which lines make them.

    ``lines`` and ``tables`` come without texts and cells, which ``body(_row, text)`` and
    ``cells(_box, rows)`` have. Chunks of lines are named by ``_first``, the least ``_row`` in them; those of
    tables have no such name but their ``text``. Members are ``(_row, _first, _i)``, ``_i`` being their order.
    """
    at = lambda kind, n: F.struct("page_pdf", F.col("_y").alias("y"), F.lit(kind).alias("kind"), *n)
    own = [F.bround("y0", 1).alias("b"), F.col("x0").alias("x"), F.col("line_no").cast("int").alias("n")]
    rows = lines.withColumn("_y", F.col("y0")).select("doc_id", "place", "page_pdf", "_row", "_n", at(1, own).alias("at"))
    none = [F.lit(0.0).alias("b"), F.lit(0.0).alias("x"), F.col("table_no").cast("int").alias("n")]
    boxes = tables.withColumn("_y", F.col("bbox.y0")).select("doc_id", "place", "page_pdf", "_box", "kind", "caption", "residual", at(0, none).alias("at"))
    marks = rows.withColumn("is_table", F.lit(0)).unionByName(boxes.drop("kind", "caption", "residual").withColumn("is_table", F.lit(1)), allowMissingColumns=True)
    section, island = ["doc_id", "place"], ["doc_id", "place", "island"]
    marks = staged(counted_before(dealt(marks, *section, "at"), section, "at", "is_table", "island").drop("_part"))
    marks = marks.join(marks.groupBy(*island).agg(F.sum(F.when(F.col("is_table") == 0, F.col("_n")).otherwise(0)).alias("chars"), F.max("is_table").alias("closed")), island)
    short = (F.col("closed") == 1) & (F.col("chars") < lead_in)
    leads = staged(marks.where(short & (F.col("is_table") == 0)).select(*island, "at", "_row"))
    lead = leads.join(rows_of(body, leads).select("_row", X.strip("text").alias("t")), "_row").groupBy(*island).agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("parts"))
    lead = lead.select(*island, F.concat(F.array_join(F.transform("parts", lambda p: p["t"]), "\n"), F.lit("\n")).alias("lead"))
    loose = marks.where((F.col("is_table") == 0) & ~short).select(*island, "at", "_row", "_n")
    runs = packed(loose, island, ["at", "_row"], "_n", limit)
    chunk = W.partitionBy(*island, "run")
    members = staged(runs.select(*island, "run", F.col("at.page_pdf").alias("page"), "_row", "_n", F.min("_row").over(chunk).alias("_first"), F.row_number().over(chunk.orderBy("at", "_row")).alias("_i")))
    texts = members.groupBy(*island, "run").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min("_first").alias("_first"), F.sum("_n").alias("_size")).where("_size > 0")
    texts = texts.select(*island, F.lit(0).alias("kind"), "run", F.lit("text").alias("content_type"), "page_start", "page_end", F.lit("").alias("caption"), "_first", F.lit(None).cast("string").alias("text"))
    keyed = marks.where("is_table = 1").select("_box", "island")
    parts = boxes.join(keyed, "_box").join(lead, island, "left").join(cells.select("_box", "rows"), "_box")
    parts = table_parts(parts)
    caption = F.when(F.col("caption") != "", F.concat("caption", F.lit("\n"))).otherwise("")
    first = F.when(F.col("part") == 0, F.concat(caption, F.coalesce("lead", F.lit("")))).otherwise("")
    parts = parts.select(
        *island, F.lit(1).alias("kind"), F.col("part").alias("run"), F.col("kind").alias("content_type"), F.col("page_pdf").alias("page_start"), F.col("page_pdf").alias("page_end"),
        "caption", F.lit(None).cast("long").alias("_first"), F.concat(first, F.col("text")).alias("text"),
    )
    number = F.row_number().over(W.partitionBy("doc_id", "place").orderBy("island", "kind", "run")) - 1
    heads = texts.unionByName(parts).withColumn("number", number).drop("island", "kind", "run")
    return staged(heads, compression="zstd"), members.select("_row", "_first", "_i")


def with_texts(heads: DataFrame, members: DataFrame, body: DataFrame) -> DataFrame:
    """``heads`` with the texts of their lines in ``text``, joined by line breaks.

    Each text is shuffled once, to the block of lines that its chunk begins in. Texts go by their own
    number, so lines that stand in another block than their chunk's first are looked up before.
    """
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    text = X.strip(F.coalesce("text", F.lit(""))).alias("_t")
    far = block("_row") != block("_first")
    strays = staged(members.where(far))
    strays = strays.join(rows_of(body, strays).select("_row", text), "_row").withColumn("_b", block("_first"))
    near = members.where(~far).withColumn("_b", block("_row"))
    own = body.select(block("_row").alias("_b"), "_row", text)
    lines = heads.where("_first IS NOT NULL")
    named = lines.select(block("_first").alias("_b"), (-1 - F.col("_first")).alias("_row"), "_first", F.struct(*[c for c in heads.columns if c not in ("_first", "text")]).alias("_head"))
    every = own.unionByName(near, True).unionByName(strays, True).unionByName(named, True).repartition("_b")
    met = every.groupBy("_b", "_row").agg(F.max("_first").alias("_first"), F.max("_i").alias("_i"), F.max("_t").alias("_t"), F.first("_head", True).alias("_head")).where("_first IS NOT NULL")
    part = F.when(F.col("_i").isNotNull(), F.struct("_i", "_t"))  # nulls are not collected
    met = met.groupBy("_b", "_first").agg(F.array_sort(F.collect_list(part)).alias("_parts"), F.first("_head", True).alias("_head")).where("_head IS NOT NULL")
    made = met.select("_head.*", F.array_join(F.transform("_parts", lambda p: p["_t"]), "\n").alias("text"))
    return made.unionByName(heads.where("_first IS NULL").drop("_first"))
