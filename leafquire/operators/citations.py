"""Citations of laws in chunk texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.sources.stage import staged


def extract(chunks: DataFrame, aliases, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(chunk_id, doc_id, law, target, raw)``: each citation of a chunk once.

    Articles without a law are dropped, attachments keep an empty law. Of citations of
    the same law and target the first stands, articles before attachments. All of it
    happens inside the row; texts without a sign of a citation are skipped first.
    """
    body = F.col(text)
    group = lambda pattern, g: F.regexp_extract_all(body, F.lit(pattern), g)

    def found(pattern: str, kind: int, groups: int):
        zipped = F.arrays_zip(*[group(pattern, g).alias(f"g{g}") for g in range(groups + 1)])
        target = lambda m: X.squash(m["g2"]) if groups == 2 else F.concat(m["g2"], m["g3"])
        return F.transform(zipped, lambda m: F.struct(F.when(m["g1"] != "", X.resolve(m["g1"], aliases)).otherwise("").alias("law"), target(m).alias("target"), X.strip(m["g0"]).alias("raw")))

    articles = F.when(body.contains("조"), F.filter(found(P.ARTICLE, 0, 2), lambda m: m["law"] != ""))
    attachments = F.when(body.contains("별"), found(P.ATTACHMENT, 1, 3))
    none = F.array().cast("array<struct<law:string,target:string,raw:string>>")
    every = F.concat(F.coalesce(articles, none), F.coalesce(attachments, none))
    rows = chunks.where(body.contains("조") | body.contains("별")).select(F.col(key).alias("chunk_id"), "doc_id", every.alias("every"))
    placed = rows.select("chunk_id", "doc_id", F.posexplode("every").alias("at", "m")).select("chunk_id", "doc_id", "at", "m.law", "m.target", "m.raw")
    best = placed.groupBy("chunk_id", "doc_id", "law", "target").agg(F.min(F.struct("at", "raw")).alias("first"))
    return best.select("chunk_id", "doc_id", "law", "target", F.col("first.raw").alias("raw"))


def lookup(asked: DataFrame, refs: DataFrame, chunks: DataFrame, sections: DataFrame, limit: int = 5) -> DataFrame:
    """Chunks that cite ``(ask_id, target, law)``: the first ``limit`` by id, and how many there are.

    Spaces in a target do not count; a null law stands for any law.
    """
    wanted = asked.select("ask_id", X.squash(F.col("target")).alias("target"), F.col("law").alias("want_law"))
    hits = refs.join(wanted, "target").where(F.col("want_law").isNull() | (F.col("law") == F.col("want_law"))).select("ask_id", "chunk_id").dropDuplicates()
    # Hits are counted where they are, and each task sends only its first ``limit`` of a target: no window holds a frequent target's hits.
    hits = staged(hits)
    totals = hits.groupBy("ask_id").agg(F.count("*").alias("n_total"))
    first = hits.withColumn("rank", F.row_number().over(W.partitionBy("ask_id").orderBy("chunk_id"))).where(F.col("rank") <= limit)
    hits = first.join(totals, "ask_id")
    about = chunks.select("chunk_id", "section_id", F.col("page_printed_start").alias("page"))
    return hits.join(about, "chunk_id").join(sections.select("section_id", "title"), "section_id", "left")
