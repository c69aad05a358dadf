"""The operators' inputs taken from the tables of a data folder, each over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.functions import patterns as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _section(c: str) -> Column:
    """Sections of a hundred documents: more documents make more sections, not larger ones."""
    return F.concat(F.lit("s"), F.floor(F.col(c) / 100).cast("string"))


def chunks(spark, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the document, the language the content type."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("chunk_id"), _section("doc_id").alias("section_id"),
        F.col("source").alias("doc_id"), F.col("lang").alias("content_type"), F.coalesce("text", F.lit("")).alias("text"),
        (F.col("doc_id") % 50 + 1).cast("int").alias("page_printed_start"), F.length("text").alias("char_count"),
    )


def sections(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(_section("doc_id").alias("section_id")).distinct()
    n = F.substring("section_id", 2, 9).cast("int")
    return d.select(
        "section_id", F.lit("d").alias("doc_id"), F.concat(F.lit("Section "), n.cast("string")).alias("title"), F.array(F.lit("All"), F.concat(F.lit("Section "), n.cast("string"))).alias("level_path"),
        F.when(n % 7 > 0, n).alias("page_printed_start"), F.when(n % 7 > 0, n + n % 3).alias("page_printed_end"),
    )


def queries(spark, sf_dir: str) -> DataFrame:
    """Each whole benchmark passage as a query; every third looks in English only, every fifth in one source."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"),
        F.when(F.col("item_id") % 5 == 0, "src1").alias("doc_id"), F.when(F.col("item_id") % 3 == 0, "en").alias("content_type"),
    )


def hybrid_queries(spark, sf_dir: str) -> DataFrame:
    """``queries``; those that share a number with one of ``vector_queries`` have its vector."""
    return queries(spark, sf_dir).join(vector_queries(spark, sf_dir).select("query_id", "embedding"), "query_id", "left")


def vectors(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding"), F.concat(F.lit("g"), F.col("label").cast("string")).alias("doc_id"), F.lit("text").alias("content_type"))


def vector_queries(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query, under its passage's number: the id over 100."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    return e.select(F.expr("vec_id div 100").cast("string").alias("query_id"), F.col("embedding"), F.when(F.col("vec_id") % 300 == 0, F.concat(F.lit("g"), F.col("label").cast("string"))).alias("doc_id"), F.lit(None).cast("string").alias("content_type"))


def lines(spark, sf_dir: str) -> DataFrame:
    """Document lines, eight to a page, the first in the margin and the last in the foot; short ones are typeset."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    short = F.length("text").between(1, 40)
    n = F.col("line_no")
    return d.select(
        "doc_id", (1 + F.floor(n / 8)).cast("int").alias("page_pdf"), "line_no", "text", F.when(short, 14.0).otherwise(10.0).alias("size"), short.alias("bold"),
        F.lit(72.0).alias("x0"), (40.0 + 110 * (n % 8)).alias("y0"), F.lit(842.0).alias("page_height"),
    )


def profiles(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    count = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    i = F.col("doc_id")
    rules = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(n).alias("level")) for p, n in P.LEVELS["chapter"]])
    return d.select(
        i.cast("string").alias("doc_id"), F.concat(F.lit("Manual "), i.cast("string")).alias("short_title"), (i % 3).cast("int").alias("page_offset"),
        (1 + F.floor((count - 1) / 8)).cast("int").alias("page_count"), F.when(i % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("toc_pdf_pages"),
        F.lit(10.4).alias("body_size"), rules.alias("level_rules"), F.create_map(*[F.lit(x) for kv in P.ALIASES.items() for x in kv]).alias("alias_map"),
        F.array(F.struct(F.lit(6).alias("lo"), F.lit(7).alias("hi"))).alias("form_ranges"),
    )


def headings(spark, sf_dir: str) -> DataFrame:
    """The short body lines as headings; the level follows from their length."""
    rows = lines(spark, sf_dir).where("bold AND y0 >= 60 AND y0 <= page_height - 60 AND trim(text) != ''")
    return rows.select("doc_id", F.col("line_no").alias("ord"), F.col("text").alias("title"), (1 + F.length("text") % 4).cast("int").alias("level"), "page_pdf", "y0", F.lit("exact").alias("method"))


def numbered_lines(spark, sf_dir: str) -> DataFrame:
    """``lines`` with a printed page number at the foot of each page; every seventh page of a document has a wrong one."""
    rows = lines(spark, sf_dir)
    page = F.col("page_pdf")
    printed = page - F.col("doc_id").cast("long") % 3 + F.when(page % 7 == 0, 1).otherwise(0)
    text = F.when(page % 2 == 0, F.concat(F.lit("/ "), printed.cast("string"), F.lit(" /"))).otherwise(printed.cast("string"))
    feet = rows.select("doc_id", "page_pdf", "page_height").distinct().where(printed >= 0)
    feet = feet.select("doc_id", "page_pdf", F.lit(-1).alias("line_no"), text.alias("text"), F.lit(9.0).alias("size"), F.lit(False).alias("bold"), F.lit(300.0).alias("x0"), F.lit(815.0).alias("y0"), "page_height")
    return rows.unionByName(feet)


def two_columns(spark, sf_dir: str) -> DataFrame:
    """``lines`` set in two columns, the right one first and a hair higher."""
    n = F.col("line_no")
    return lines(spark, sf_dir).withColumn("y0", 40.0 + 110 * F.floor(n % 8 / 2) + 0.02 * (n % 2)).withColumn("x0", F.when(n % 2 == 0, 300.0).otherwise(72.0))


def raw_tables(spark, sf_dir: str) -> DataFrame:
    """Every eleventh line as a table of its words, four to a row; every other box also covers the line below."""
    words = F.filter(F.split("text", r"[ \t\r\f]+"), lambda w: w != "")
    rows = lines(spark, sf_dir).where("line_no % 11 = 3").withColumn("w", words).where(F.size("w") > 0)
    cells = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 4).cast("int")), lambda i: F.slice("w", i * 4 + 1, F.lit(4)))
    top, bottom = F.col("y0") - 80, F.col("y0") + F.when(F.col("line_no") % 22 == 3, 20).otherwise(130)
    return rows.select("doc_id", "page_pdf", F.col("line_no").alias("table_no"), F.struct("x0", top.alias("y0"), F.lit(500.0).alias("x1"), bottom.alias("y1")).alias("bbox"), cells.alias("rows"))


def contents(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A hundred parts each as a document's contents lines, every third over two lines; and the profiles.

    Between them stand lines that make no entry: with a skip word, a bullet, or dots without a page.
    """
    p = table(spark, sf_dir, "part").withColumn("doc_id", F.concat(F.lit("p"), F.expr("p_partkey div 100").cast("string")))
    n = F.col("p_partkey")
    number, page = n.cast("string"), F.col("p_size").cast("string")
    head = F.when(n % 20 == 0, F.concat(F.lit("제"), number, F.lit("장 "), F.col("p_name"))).when(n % 20 == 1, F.col("p_name")).otherwise(F.concat(number, F.lit(". "), F.col("p_name")))
    two = F.array(head, F.concat(F.lit("more ····· "), page))
    one = F.array(F.concat(head, F.lit(" ····· "), page, F.when(n % 4 == 0, F.concat(F.lit(" [표 "), number, F.lit("] x ··· 7"))).otherwise("")))
    noise = F.when(n % 10 == 5, F.array(F.concat(F.lit("CONTENTS "), number))).when(n % 10 == 7, F.array(F.concat(F.lit("● note "), number, F.lit(" ··· 9")))).when(n % 10 == 9, F.array(F.lit("·····"))).otherwise(F.array().cast("array<string>"))
    rows = p.select("doc_id", n.alias("key"), F.posexplode(F.concat(noise, F.when(n % 3 == 0, two).otherwise(one))).alias("i", "text"))
    at = F.col("key") * 3 + F.col("i")
    out = rows.select(
        "doc_id", F.lit(1).alias("page_pdf"), at.cast("int").alias("line_no"), "text", F.lit(10.0).alias("size"), F.lit(False).alias("bold"),
        F.lit(72.0).alias("x0"), at.cast("double").alias("y0"), F.lit(1e9).alias("page_height"),
    )
    rules = F.array(*[F.struct(F.lit(x).alias("pattern"), F.lit(k).alias("level")) for x, k in P.LEVELS["chapter"]])
    about = p.select("doc_id").distinct().select(
        "doc_id", F.col("doc_id").alias("short_title"), F.lit(0).alias("page_offset"), F.lit(60).alias("page_count"), F.array(F.lit(1)).alias("toc_pdf_pages"), F.lit(10.0).alias("body_size"),
        rules.alias("level_rules"), F.create_map(F.lit("a"), F.lit("b")).alias("alias_map"), F.array(F.struct(F.lit(1).alias("lo"), F.lit(50).alias("hi"))).alias("form_ranges"),
    )
    return out, about


def form_pages(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A hundred parts each as the form lists of a document's two appendices, 50 parts to a cover page.

    Some forms are deleted, some lines have no form number; an appendix declares 50 forms, or none.
    """
    p = table(spark, sf_dir, "part").withColumn("doc_id", F.concat(F.lit("p"), F.expr("p_partkey div 100").cast("string")))
    n = F.col("p_partkey")
    second, j = (n % 100 >= 50).cast("int"), (n % 50).cast("int")
    name = F.when(j % 9 == 4, F.lit("삭제")).otherwise(F.col("p_name"))
    number = F.when(j % 3 == 0, F.concat(F.lit("제 "), j.cast("string"), F.lit(" 호 "))).when(j % 3 == 1, F.concat(F.lit("별표 "), j.cast("string"), F.lit(" "))).otherwise(F.concat(j.cast("string"), F.lit(". ")))
    page = (F.lit(10) + j + 51 * second).cast("string")
    text = F.concat(F.when(j % 11 == 7, F.lit("")).otherwise(number), name, F.lit(" ···· "), page)
    rows = p.select("doc_id", F.when(second == 1, 60).otherwise(3).alias("page_pdf"), (j + 10).alias("line_no"), text.alias("text"), F.lit(10.0).alias("size"), (120.0 + 10 * j).alias("y0"))
    head = lambda n, text, size, y: F.struct(F.lit(n).alias("line_no"), text.alias("text"), F.lit(size).alias("size"), F.lit(y).alias("y0"))
    heads = rows.select("doc_id", "page_pdf").distinct().select("doc_id", "page_pdf", F.explode(F.array(
        head(0, F.lit("7"), 10.0, 80.0),
        head(1, F.when(F.col("page_pdf") == 3, "<부록 1> 서식").otherwise("<부록 3> 서식"), 20.0, 100.0),
        head(2, F.when(F.col("page_pdf") == 3, "모음(50종)").otherwise("모음"), 20.0, 110.0),
    )).alias("x")).select("doc_id", "page_pdf", "x.*")
    out = rows.unionByName(heads).select("doc_id", "page_pdf", "line_no", "text", "size", F.lit(False).alias("bold"), F.lit(72.0).alias("x0"), "y0", F.lit(842.0).alias("page_height"))
    about = p.select("doc_id").distinct().select("doc_id", F.concat(F.lit("Manual "), "doc_id").alias("short_title"), F.lit(0).alias("page_offset"), F.array(F.struct(F.lit(3).alias("lo"), F.lit(200).alias("hi"))).alias("form_ranges"))
    return out, about


def titled_pages(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Web pages as documents: entries, lines and profiles.

    Each piece of text behind a tag of the whole page is a line, twenty to a page;
    headings and bold text are typeset. The ``<title>`` is the entry: some are numbered,
    cut, changed or replaced, so that all ways to match occur.
    """
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("page_id").alias("i"), F.coalesce("html", F.lit("")).alias("h"))
    title = F.regexp_extract("h", "(?s)<title>(.*?)</title>", 1)
    kind = F.col("i") % 4
    given = F.when(kind == 0, title).when(kind == 1, F.substring(title, 1, 12)).when(kind == 2, F.concat(F.substring(title, 1, 4), F.lit("qz"), F.substring(title, 6, 99))).otherwise(F.lit("zzzz qqqq xxxx"))
    given = F.when(F.col("i") % 5 == 0, F.concat(F.lit("3. "), given)).otherwise(given)
    entries = pages.select("doc_id", F.lit(0).alias("ord"), given.alias("title"), F.lit(1).alias("level"), F.lit(1).alias("page_printed"), F.lit(True).alias("numbered"), F.lit("section").alias("kind"))
    found = lambda g: F.regexp_extract_all("h", F.lit("<(/?[a-zA-Z][a-zA-Z0-9]*)[^<>]*>([^<>]*)"), g)
    rows = pages.select("doc_id", F.posexplode(F.arrays_zip(found(1).alias("tag"), found(2).alias("text"))).alias("line_no", "p")).select("doc_id", "line_no", "p.tag", "p.text")
    n = F.col("line_no")
    out = rows.select(
        "doc_id", (1 + F.floor(n / 20)).cast("int").alias("page_pdf"), "line_no", "text", F.when(F.col("tag").rlike("^(h[1-6]|b)$"), 14.0).otherwise(10.0).alias("size"),
        F.lit(False).alias("bold"), F.lit(72.0).alias("x0"), (100.0 + 20 * (n % 20)).alias("y0"), F.lit(842.0).alias("page_height"))
    about = pages.select("doc_id", F.lit(0).alias("page_offset"), F.lit(9).alias("page_count"), F.lit(10.0).alias("body_size"))
    return entries, out, about


#: All columns of a line item: the order of equal keys.
ITEM = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def items(spark, sf_dir: str) -> DataFrame:
    """Line items of each order, numbered ``r`` from 1."""
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ITEM)))


def cells(spark, sf_dir: str) -> DataFrame:
    """Line items of each order as table cells, some blank."""
    n = F.col("r")
    values = F.array(
        F.when(n % 3 == 0, "").otherwise(F.col("l_returnflag")), F.when(F.col("l_partkey") % 2 == 0, "").otherwise(F.col("l_linestatus")), F.col("l_quantity").cast("int").cast("string"), n.cast("string")
    )
    return items(spark, sf_dir).select(F.col("l_orderkey").alias("table_id"), "r", F.posexplode(values).alias("c", "value")).where("NOT (r % 4 = 2 AND c >= 2)")


def cited_chunks(spark, sf_dir: str) -> DataFrame:
    """Orders as chunks that cite laws, one line item after another; every seventh part's article has no law."""
    i = table(spark, sf_dir, "lineitem")
    item = F.concat(F.when(F.col("l_partkey") % 7 == 0, "그리고 ").when(F.col("l_linenumber") % 2 == 0, "혁신법 ").otherwise("시행령 "), F.lit("제"), (F.col("l_partkey") % 60 + 1).cast("string"), F.lit("조제"), F.col("l_linenumber").cast("string"), F.lit("항, 별표 "), (F.col("l_suppkey") % 9).cast("string"))
    rows = i.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("t")))), lambda x: x["t"]), " 및 ").alias("text"))
    return rows.select(F.col("l_orderkey").cast("string").alias("chunk_id"), F.lit("orders").alias("doc_id"), "text")


def runs(spark, sf_dir: str) -> DataFrame:
    """Assistant turns as runs: they cite every word of their text and retrieved the user's, brackets taken off."""
    c = table(spark, sf_dir, "conversations")
    words = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: F.translate(w, "[]", "")), lambda w: w != "")
    one = c.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.*")
    size = F.length(F.coalesce("text", F.lit("")))
    asked = one.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), words.alias("retrieved"), size.alias("input_tokens"))
    out = one.where("role = 'assistant'").select("conv_id", "turn", F.transform(words, lambda w: F.concat(F.lit("[ "), w, F.lit("]"))).alias("citations"), size.alias("output_tokens"))
    return out.join(asked, ["conv_id", "turn"]).select(F.col("conv_id").cast("string").alias("run_id"), "turn", "citations", "retrieved", "input_tokens", "output_tokens", F.lit(1).alias("calls"))
