"""Schemas of the tables, and how they are read and written."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "lines": "doc_id string, page_pdf int, line_no int, text string, size double, bold boolean, x0 double, y0 double, page_height double",
    "profiles": "doc_id string, short_title string, page_offset int, page_count int, toc_pdf_pages array<int>, body_size double, "
    "level_rules array<struct<pattern:string,level:int>>, alias_map map<string,string>, form_ranges array<struct<lo:int,hi:int>>",
    "toc_entries": "doc_id string, ord int, title string, level int, page_printed int, numbered boolean, kind string",
    "headings": "doc_id string, ord int, title string, level int, page_pdf int, y0 double, method string",
    "tables": "doc_id string, page_pdf int, table_no int, bbox struct<x0:double,y0:double,x1:double,y1:double>, rows array<array<string>>, caption string, kind string, residual array<string>",
    "forms": "doc_id string, appendix_no int, appendix_title string, form_no string, name string, page_start int, page_end int",
    "sections": "section_id string, doc_id string, title string, level_path array<string>, page_pdf_start int, page_pdf_end int, page_printed_start int, page_printed_end int",
    "chunks": "chunk_id string, section_id string, doc_id string, content_type string, text string, text_for_embedding string, page_pdf_start int, page_pdf_end int, "
    "page_printed_start int, page_printed_end int, char_count int, caption string",
    "refs": "chunk_id string, doc_id string, law string, target string, raw string",
    "vectors": "chunk_id string, embedding array<float>, doc_id string, content_type string",
    "queries": "query_id string, query string, doc_id string, content_type string, embedding array<float>",
    "ground_truth": "id string, query string, type string, answer_sections array<string>, must_contain array<string>, note string",
}
SCHEMAS = dict(_DDL)


def columns(name: str) -> T.StructType:
    """The fixed schema of a table."""
    return T.StructType.fromDDL(_DDL[name])


def read(spark: SparkSession, name: str, path: str, form: str = "parquet") -> DataFrame:
    """A table by its fixed schema; ``json`` files hold one object per line, blank lines skipped."""
    return spark.read.schema(_DDL[name]).format(form).load(path)


def write_json(df: DataFrame, path: str) -> DataFrame:
    """Write one JSON object per line, nulls kept and letters unescaped; the rows as read back."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def rebuild(tables: dict[str, DataFrame], path: str) -> None:
    """Replace the stored tables as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def rebuild_docs(df: DataFrame, path: str, doc_ids: list[str]) -> None:
    """Replace only the parts of a stored table that belong to ``doc_ids``."""
    (
        df.where(F.col("doc_id").isin(doc_ids)).write.mode("overwrite").partitionBy("doc_id")
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def digest(model: str, text: str = "text_for_embedding"):
    return F.sha2(F.concat(F.lit(f"{model}\u0000"), F.coalesce(F.col(text), F.lit(""))), 256)


def new_digests(chunks: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """``(digest, text_for_embedding)`` of texts that no stored vector has yet, each once."""
    wanted = chunks.select(digest(model).alias("digest"), "text_for_embedding").groupBy("digest").agg(F.min("text_for_embedding").alias("text_for_embedding"))
    return wanted.join(stored.select("digest"), "digest", "left_anti")


def embed(texts: DataFrame, call, batch: int = 128) -> DataFrame:
    """``(digest, embedding)``: ``call`` turns lists of at most ``batch`` texts into vectors.

    ``call`` runs in the tasks; it should raise on failure, and Spark retries the task.
    """

    def run(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                found = pa.array([list(v) for v in call(part.column("text_for_embedding").to_pylist())], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("digest"), found], names=["digest", "embedding"])

    return texts.select("digest", "text_for_embedding").mapInArrow(run, "digest string, embedding array<float>")


def vectors(chunks: DataFrame, stored: DataFrame, model: str, call) -> DataFrame:
    """A vector for each chunk: stored ones are kept, only new texts are embedded."""
    known = stored.select("digest", "embedding").unionByName(embed(new_digests(chunks, stored, model), call))
    return chunks.withColumn("digest", digest(model)).join(known, "digest").select("chunk_id", "embedding", "doc_id", "content_type")


def grow_vectors(store, chunks: DataFrame, model: str, call, name: str = "embeddings") -> DataFrame:
    """A vector for each chunk from the stored table ``name(digest, embedding)``, which grows by new texts.

    Only texts without a stored vector are embedded, each once; a run that dies and is
    repeated stores none twice.
    """
    spark = chunks.sparkSession
    stored = store.read(name) if name in store.manifest() else spark.createDataFrame([], "digest string, embedding array<float>")
    store.append_new(name, embed(new_digests(chunks, stored, model), call), "digest")
    return chunks.withColumn("digest", digest(model)).join(store.read(name), "digest").select("chunk_id", "embedding", "doc_id", "content_type")


def path_json(df: DataFrame) -> DataFrame:
    """Sections with ``level_path`` as JSON text."""
    return df.withColumn("level_path", F.to_json("level_path"))


def path_array(df: DataFrame) -> DataFrame:
    return df.withColumn("level_path", F.from_json("level_path", "array<string>"))
