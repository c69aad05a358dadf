"""Layout lines, contents entries, headings and the section that each line belongs to."""

from __future__ import annotations

import difflib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators.ranges import dealt, hand_over, numbered, reaching, rows_of
from leafquire.sources.stage import staged

JOINED_LINES = 4
BACK, FORWARD = 1, 3
SHORT_KEY = 4


def body_lines(lines: DataFrame) -> DataFrame:
    """Lines of text: not blank, not in the running head or foot, no page number low on a page."""
    text = X.strip(F.coalesce("text", F.lit("")))
    y, height = F.col("y0"), F.col("page_height")
    number = (y > P.FOOTER_SHARE * height) & text.rlike(P.PAGE_NUMBER)
    return lines.where((text != "") & (y >= P.MARGIN) & (y <= height - P.MARGIN) & ~number)


def body_rows(lines: DataFrame) -> DataFrame:
    """``body_lines``, written once, with a number ``_row`` and the length ``_n`` of their text without space at its ends.

    Later steps take a line's place and length, and its text only once it is known which they need.
    """
    if "_row" in lines.columns:
        return lines
    return numbered(body_lines(lines).withColumn("_n", F.length(X.strip(F.col("text")))), "_row", compression="zstd")


def footer_lines(lines: DataFrame) -> DataFrame:
    """Lines with text low on a page, of all lines."""
    return lines.where((X.strip(F.coalesce("text", F.lit(""))) != "") & (F.col("y0") > P.FOOTER_SHARE * F.col("page_height")))


def reading_order(*before: str) -> W:
    """Reading order inside ``before``: rows by height to one decimal, then from the left."""
    return W.partitionBy(*before).orderBy(F.bround("y0", 1), "x0", "line_no")


def typeset(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``typeset``: larger than the document's body text, or bold."""
    sizes = profiles.select("doc_id", "body_size")
    return lines.join(sizes, "doc_id").withColumn("typeset", (F.col("size") > F.col("body_size") + P.TYPESET_OVER) | F.coalesce("bold", F.lit(False))).drop("body_size")


def in_ranges(page, ranges):
    """Whether a printed page lies in one of the ranges of an array."""
    return F.coalesce(F.exists(ranges, lambda r: page.between(r["lo"], r["hi"])), F.lit(False))


def contents_lines(lines: DataFrame, profiles: DataFrame, keep: bool = True) -> DataFrame:
    """Lines on the contents pages of their document, or those elsewhere if not ``keep``."""
    pages = profiles.select("doc_id", F.explode("toc_pdf_pages").alias("page_pdf"))
    return lines.join(pages, ["doc_id", "page_pdf"], "left_semi" if keep else "left_anti")


def contents_entries(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(doc_id, ord, title, level, page_printed, numbered, kind)`` from contents lines.

    A line may end several entries, each by leader dots and a page; what follows the
    last one, and lines without dots, begin the next entry's title, over page ends too.
    Dotted lines without a page are ignored, as are lines with a skip word. Titles that
    are empty or begin with a bullet make no entry.
    """
    text = X.strip(F.coalesce("text", F.lit("")))
    rows = contents_lines(lines, profiles).withColumn("raw", text).where((F.col("raw") != "") & ~X.any_of(*[F.col("raw").contains(s) for s in P.TOC_SKIP]))
    ends = F.regexp_extract_all("raw", F.lit(P.TERMINATOR), 1)
    rows = rows.withColumn("pages", ends).where((F.size("pages") > 0) | ~F.col("raw").rlike(P.LEADER))
    parts = F.split("raw", P.TERMINATOR)
    page_order = F.struct("page_pdf", F.bround("y0", 1).alias("y"), "x0", "line_no")
    pieces = rows.select("doc_id", page_order.alias("at"), F.posexplode(F.transform(parts, lambda t, i: F.struct(X.strip(t).alias("t"), F.get(F.col("pages"), i).alias("page")))).alias("i", "p"))
    pieces = pieces.select("doc_id", "at", "i", "p.t", "p.page").where((F.col("t") != "") | F.col("page").isNotNull())
    order = W.partitionBy("doc_id").orderBy("at", "i")
    island = F.coalesce(F.count("page").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    islands = pieces.withColumn("island", island).groupBy("doc_id", "island").agg(
        F.array_sort(F.collect_list(F.struct("at", "i", "t"))).alias("parts"), F.max("page").cast("int").alias("page_printed")
    )
    title = X.strip(F.array_join(F.filter(F.transform("parts", lambda x: x["t"]), lambda t: t != ""), " "))
    named = islands.where("page_printed IS NOT NULL").withColumn("title", title).where((F.col("title") != "") & ~F.col("title").rlike(P.DECOR))
    named = named.join(profiles.select("doc_id", "level_rules"), "doc_id")
    level, caption = X.level_by_rules(F.col("title"), F.col("level_rules")), F.col("title").rlike(P.CAPTION)
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("island")) - 1
    return named.select(
        "doc_id", number.alias("ord"), "title", F.when(caption, 0).otherwise(F.coalesce(level, F.lit(1))).alias("level"), "page_printed",
        (caption | level.isNotNull()).alias("numbered"), F.when(caption, "caption").otherwise("section").alias("kind"),
    )


def _targets(entries: DataFrame) -> DataFrame:
    full, bare = X.match_key(F.col("title")), X.match_key(X.strip_number(F.col("title")))
    both = F.array_distinct(F.array(full, bare))
    long = F.filter(both, lambda t: F.length(t) >= SHORT_KEY)
    return entries.withColumn("targets", F.when(F.size(long) > 0, long).otherwise(F.filter(both, lambda t: t != "")))


def _joined_keys(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """From each typeset line the keys of it and up to three lines after it, joined: computed once.

    Only the texts of these lines are shuffled.
    """
    body = body_rows(lines)
    line = ["doc_id", "page_pdf", "n"]
    rows = staged(body.withColumn("n", F.row_number().over(reading_order("doc_id", "page_pdf"))).select(*line, "y0", "size", "bold", "_row"))
    begins = typeset(rows, profiles).where("typeset").select(*line, "y0")
    wanted = begins.select("doc_id", "page_pdf", F.explode(F.sequence(F.col("n"), F.col("n") + JOINED_LINES - 1)).alias("n"))
    rows = staged(rows.select(*line, "_row").join(wanted, line, "left_semi"))
    rows = rows.join(rows_of(body, rows).select("_row", X.match_key(F.col("text")).alias("key")), "_row")
    order = W.partitionBy("doc_id", "page_pdf").orderBy("n")
    after = [F.lead("key", n).over(order) for n in range(1, JOINED_LINES)]
    rows = rows.withColumn("keys", F.array("key", *after)).select(*line, "keys").join(begins, line).withColumn("keys", F.filter("keys", lambda k: k.isNotNull()))
    runs = F.transform(F.sequence(F.lit(1), F.size("keys")), lambda k: F.array_join(F.slice("keys", F.lit(1), k), ""))
    return rows.select("doc_id", "page_pdf", "y0", "n", F.posexplode(runs).alias("extra", "joined")).where("joined != ''")


def _windows(entries: DataFrame, profiles: DataFrame) -> DataFrame:
    base = F.col("page_printed") + F.col("page_offset")
    rows = _targets(entries).join(profiles.select("doc_id", "page_offset", "page_count"), "doc_id").withColumn("base", base)
    pages = F.filter(F.sequence(F.col("base") - BACK, F.col("base") + FORWARD), lambda p: (p >= 1) & (p <= F.col("page_count")))
    return rows.withColumn("pages", pages)


@F.pandas_udf(T.DoubleType())
def _ratio(joined: pd.Series, target: pd.Series) -> pd.Series:
    """The ratio of each pair; a cheaper upper bound in its place where that is already too low."""
    out, match = [], difflib.SequenceMatcher()
    for a, b in zip(joined, target):
        if b != match.b:
            match.set_seq2(b)
        match.set_seq1(a)
        bound = match.quick_ratio()
        out.append(match.ratio() if bound >= P.FUZZY_MIN else bound)
    return pd.Series(out, dtype=float)


def pin_headings(entries: DataFrame, lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(doc_id, ord, title, level, page_pdf, y0, method)``: where each entry's title stands.

    Candidates stand from one page before to three after the stated one. First wins the
    earliest page with an exact or prefix match: there the first exact line, else the
    longest share matched. Entries that match nowhere go to the best similar title, at
    0.72 or more on the earliest such page; the rest to the stated page's top ('none').
    """
    wanted = _windows(entries, profiles).select("doc_id", "ord", "targets", F.explode("pages").alias("page_pdf"))
    keys = staged(_joined_keys(lines, profiles))
    pairs = wanted.join(keys, ["doc_id", "page_pdf"]).withColumn("target", F.explode("targets"))
    fits = F.col("joined").startswith(F.col("target"))
    score = 2 * F.length("target") / (F.length("joined") + F.length("target"))
    # A longer run counts only if every shorter one is itself the beginning of a target.
    shorter = F.exists("targets", lambda t: t.startswith(F.col("head")))
    runs = W.partitionBy("doc_id", "ord", "page_pdf", "n", "target").orderBy("extra")
    pairs = pairs.withColumn("head", F.lag("joined").over(runs)).where(F.col("head").isNull() | shorter)
    hits = pairs.where(fits).withColumn("exact", F.col("joined") == F.col("target")).withColumn("score", score)
    entry = W.partitionBy("doc_id", "ord")
    best = entry.orderBy("page_pdf", F.col("exact").desc(), F.when(F.col("exact"), 0.0).otherwise(F.col("score")).desc(), "n", "extra")
    sure = staged(hits.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "ord", "page_pdf", "y0", F.when(F.col("exact"), "exact").otherwise("prefix").alias("method")))
    left = wanted.join(sure.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")
    # At most the shorter one of a pair can match whole, which rules out most pairs by their lengths.
    most = 2 * F.least(F.length("joined"), F.length("target")) / (F.length("joined") + F.length("target"))
    near = left.join(keys, ["doc_id", "page_pdf"]).withColumn("target", F.explode("targets")).where(most >= P.FUZZY_MIN)
    near = near.withColumn("score", _ratio("joined", "target")).where(F.col("score") >= P.FUZZY_MIN)
    order = entry.orderBy("page_pdf", F.col("score").desc(), "n", "extra")
    fuzzy = near.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "ord", "page_pdf", "y0", F.lit("fuzzy").alias("method"))
    found = sure.unionByName(fuzzy)
    base = _windows(entries, profiles).select("doc_id", "ord", "title", "level", "base")
    return base.join(found, ["doc_id", "ord"], "left").select(
        "doc_id", "ord", "title", "level", F.coalesce("page_pdf", "base").alias("page_pdf"), F.coalesce("y0", F.lit(0.0)).alias("y0"), F.coalesce("method", F.lit("none")).alias("method")
    )


def _heading_order():
    return W.partitionBy("doc_id").orderBy("page_pdf", "y0", "ord")


def grown(stack: list, level: int, title) -> list:
    """Open headings ``(level, title)`` after one more: those of its level or below close."""
    while stack and stack[-1][0] >= level:
        stack.pop()
    stack.append((level, title))
    return stack


def joined(before: list, low: int, pushed: list) -> list:
    """Open headings after a run that by itself leaves ``pushed`` open and whose least level is ``low``.

    ``(low, pushed)`` stands for a whole run of headings, and runs compose in any grouping.
    """
    return [x for x in before if x[0] < low] + pushed


def level_paths(headings: DataFrame) -> DataFrame:
    """Add ``level_path``: the titles of a heading's ancestors and its own, whatever its level.

    An ancestor is the last heading before of its level, if none of the same or a lower
    level came after it. A null level counts as 1; null titles are left out of the path.
    Headings are dealt by range, so a document may be many tasks: each range is summed up
    as its least level and the headings it leaves open (at most one a level), the ranges'
    sums are composed in order, and each range starts from what those before left open.
    """
    order = ["doc_id", "page_pdf", "y0", "ord"]
    rows = headings.drop("level_path").withColumn("_level", F.coalesce("level", F.lit(1)).cast("int"))
    dealt = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    start = dealt.sparkSession.sparkContext.broadcast(_open_before(dealt, order))  # at most one entry a range
    schema = T.StructType([f for f in dealt.schema.fields if f.name not in ("_level", "_part")] + [T.StructField("level_path", T.ArrayType(T.StringType()))])

    def run(batches):
        last, stack = None, []
        for batch in batches:
            paths = []
            for part, doc, level, title in zip(*(batch.column(c).to_pylist() for c in ("_part", "doc_id", "_level", "title"))):
                if last != (part, doc):
                    known, opened = start.value.get(part, (doc, []))
                    stack = list(opened) if known == doc and (last is None or last[0] != part) else []
                    last = part, doc
                grown(stack, level, title)
                paths.append([t for _level, t in stack if t is not None])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(paths, pa.list_(pa.string()))], names=schema.names)

    return dealt.repartition("_part").sortWithinPartitions("_part", *order).mapInArrow(run, schema)


def _open_before(dealt: DataFrame, order: list[str]) -> dict:
    """For each range the document that the one before it ends in, and the headings that stand open there."""

    def run(batches):
        out: dict = {}
        for batch in batches:
            for part, doc, level, title in zip(*(batch.column(c).to_pylist() for c in ("_part", "doc_id", "_level", "title"))):
                if part not in out or out[part][0] != doc:
                    out[part] = doc, level, []
                _doc, low, stack = out[part]
                out[part] = doc, min(low, level), grown(stack, level, title)
        at = list(out.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in at], pa.int32()), pa.array([x[0] for _, x in at], pa.string()), pa.array([x[1] for _, x in at], pa.int32()),
             pa.array([[v for v, _ in x[2]] for _, x in at], pa.list_(pa.int32())), pa.array([[t for _, t in x[2]] for _, x in at], pa.list_(pa.string()))],
            names=["part", "doc_id", "low", "levels", "titles"])

    thin = dealt.select("_part", *order, "_level", "title").repartition("_part").sortWithinPartitions("_part", *order)
    found = thin.mapInArrow(run, "part int, doc_id string, low int, levels array<int>, titles array<string>").orderBy("part").collect()  # one row a range
    start, before = {}, None
    for r in found:
        pushed = list(zip(r.levels, r.titles))
        if before is not None:
            start[r.part] = before
        before = r.doc_id, joined(before[1], r.low, pushed) if before is not None and before[0] == r.doc_id else pushed
    return start


def section_spans(headings: DataFrame, profiles: DataFrame, fronts: DataFrame | None = None) -> DataFrame:
    """Headings with the end of their section, their id, and whether a section is kept.

    A section ends on the page of the next heading, the last one on the last page.
    Headings in a form appendix end the one before but are no sections (null id). Kept
    ones are numbered from 0, or from 1 where ``fronts(doc_id)`` has the document.
    """
    order = _heading_order()
    rows = headings.join(profiles.select("doc_id", "page_offset", "page_count", "form_ranges"), "doc_id")
    rows = rows.withColumn("end_page", F.coalesce(F.lead("page_pdf").over(order), F.col("page_count"))).withColumn("next_y", F.lead("y0").over(order))
    rows = rows.withColumn("kept", ~in_ranges(F.col("page_pdf") - F.col("page_offset"), F.col("form_ranges"))).withColumn("place", F.row_number().over(order))
    if fronts is not None:
        rows = rows.join(fronts.select("doc_id").distinct().withColumn("front", F.lit(1)), "doc_id", "left")
    else:
        rows = rows.withColumn("front", F.lit(0))
    number = F.sum(F.col("kept").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1 + F.coalesce("front", F.lit(0))
    return rows.withColumn("section_id", F.when(F.col("kept"), F.format_string("%s-s%03d", "doc_id", number))).drop("page_offset", "page_count", "form_ranges", "front")


def assign(items: DataFrame, spans: DataFrame, y: str = "y0") -> DataFrame:
    """Add ``place``: the heading that an item belongs to, 0 for front matter, or drop the item.

    An item belongs to the latest heading above it if it stands at least 1 below that
    one and, on the next heading's page, at least 1 above that. Items and headings are
    dealt by range of (document, page, height), so a document may be many tasks; each range
    is told the last heading before it and the first after it. No join of unequal keys.
    """
    place = ["doc_id", "page_pdf", "_y", "_kind"]
    marks = spans.select("doc_id", "page_pdf", F.col("y0").alias("_y"), F.lit(0).alias("_kind"), F.struct("place", "page_pdf", F.col("y0").alias("y")).alias("_mark"))
    rows = items.withColumn("_y", F.col(y)).withColumn("_kind", F.lit(1))
    both = dealt(rows.unionByName(marks, allowMissingColumns=True), *place)
    mark = F.when(F.col("_mark").isNotNull(), F.struct("page_pdf", "_y", "_mark.place", "_mark"))
    sums = reaching(both.groupBy("doc_id", "_part").agg(F.min(mark)["_mark"].alias("_first"), F.max(mark)["_mark"].alias("_last")), ["doc_id"])
    # What comes after is taken in reverse order: a frame that ends at the last row is read anew for each row.
    ranges, back = W.partitionBy("doc_id").orderBy("_part"), W.partitionBy("doc_id").orderBy(F.col("_part").desc())
    sums = sums.select(
        "doc_id", "_part", F.last("_last", ignorenulls=True).over(ranges.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)).alias("_after"),
    )
    by = [F.col(c) for c in ("page_pdf", "_y", "_kind", "_mark.place")]
    order, back = W.partitionBy("_part", "doc_id").orderBy(*by), W.partitionBy("_part", "doc_id").orderBy(*[c.desc() for c in by])
    both = both.withColumn("_above", F.last("_mark", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("_below", F.last("_mark", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)))
    mine = hand_over(both.where("_kind = 1"), sums, ["doc_id"])
    mine = mine.withColumn("_above", F.coalesce("_above", "_before")).withColumn("_below", F.coalesce("_below", "_after"))
    after = F.col("_above").isNull() | (F.col("_above.page_pdf") < F.col("page_pdf")) | (F.col("_y") >= F.col("_above.y") + 1)
    before = F.col("_below").isNull() | (F.col("_below.page_pdf") > F.col("page_pdf")) | (F.col("_y") <= F.col("_below.y") - 1)
    kept = mine.where(after & before).withColumn("place", F.coalesce(F.col("_above.place"), F.lit(0)))
    return kept.drop("_y", "_kind", "_mark", "_above", "_below", "_before", "_after", "_part")
