"""Vector search, fusion of rankings, and results as sections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators.best import Best, allowed, in_blocks, strings
from leafquire.operators.keyword import keyword_search, top

#: Queries that are held against all vectors in one pass.
QUERY_BLOCK = 2048
#: More than a distance by matrix product can be wrong.
SLACK = 1e-6


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = P.POOL) -> DataFrame:
    """``(query_id, chunk_id, distance, rank)``: the nearest vectors by L2 distance at unit length.

    Queries without a vector have no rows. Blocks of queries go to all tasks as one
    matrix; each task keeps the best ``k`` of each query over all its vectors, so only
    few rows meet in the ranking. Filters by ``doc_id`` and ``content_type`` come before the cut.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", X.unit(F.col("embedding")).alias("v"), "doc_id", "content_type").where("v IS NOT NULL")
    stored = vectors.select("chunk_id", X.unit(F.col("embedding").cast("array<double>")).alias("v"), "doc_id", "content_type").where("v IS NOT NULL")
    found = stored.sparkSession.createDataFrame([], "query_id string, chunk_id string, distance double")
    for block in in_blocks(asked, QUERY_BLOCK):
        found = found.unionByName(_nearest(block, stored, k))
    return top(found, k, "distance")


def _nearest(block: list, stored: DataFrame, k: int) -> DataFrame:
    """Each task's nearest ``k`` of each query of a block.

    One matrix product gives all distances of a batch up to rounding; those that may
    count are then taken exactly.
    """
    ids = [r.query_id for r in block]
    limits = [(r.doc_id, r.content_type) for r in block]
    model = stored.sparkSession.sparkContext.broadcast((ids, np.array([r.v for r in block]), limits))  # at most QUERY_BLOCK vectors

    def run(batches):
        ids, matrix, limits = model.value
        best = Best(len(ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names, passes = strings(batch.column("chunk_id")), allowed(batch, limits)
            about = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (matrix @ v.T)))
            for i, q in enumerate(matrix):
                at = np.arange(len(v)) if passes[i] is None else np.flatnonzero(passes[i])
                near = about[i, at]
                most = best.limit(i)
                if len(near) > k:
                    most = min(most, np.partition(near, k - 1)[k - 1])
                at = at[near <= most + SLACK]
                diff = v[at] - q
                best.add(i, np.sqrt(np.einsum("ij,ij->i", diff, diff)), names[at])
        yield best.rows(ids, "distance")

    return stored.mapInArrow(run, "query_id string, chunk_id string, distance double")


def fuse(keyword: DataFrame, vector: DataFrame, k: int = P.FUSION_K, weights=(P.KEYWORD_WEIGHT, P.VECTOR_WEIGHT)) -> DataFrame:
    """``(query_id, chunk_id, score, fused_rank, keyword_rank, vector_rank)``.

    Each list adds weight / (k + rank), ranks from 1. Ties keep the keyword list's
    order, then the vector list's.
    """
    sides = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"), F.lit(None).cast("int").alias("vector_rank")).unionByName(
        vector.select("query_id", "chunk_id", F.lit(None).cast("int").alias("keyword_rank"), F.col("rank").alias("vector_rank"))
    )
    both = sides.groupBy("query_id", "chunk_id").agg(F.min("keyword_rank").alias("keyword_rank"), F.min("vector_rank").alias("vector_rank"))
    part = lambda c, w: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", part("keyword_rank", weights[0]) + part("vector_rank", weights[1]))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("keyword_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last())
    return both.withColumn("fused_rank", F.row_number().over(order))


def best_sections(fused: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """``(query_id, rank, section_id, matched_chunk_id, score)``: each section by its first chunk.

    Hits whose chunk is gone are dropped. The cut comes before sections are looked up.
    """
    known = fused.join(chunks.select("chunk_id", "section_id"), "chunk_id")
    first = W.partitionBy("query_id", "section_id").orderBy("fused_rank")
    best = known.withColumn("n", F.row_number().over(first)).where("n = 1")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("fused_rank"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "section_id", F.col("chunk_id").alias("matched_chunk_id"), "score")


def expand(results: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with their section's title, path, citation and whole text.

    Only chosen sections are read. Chunks join in the order of their ids as text.
    Results whose section is gone are dropped.
    """
    chosen = chunks.join(results.select("section_id").distinct(), "section_id", "left_semi")
    texts = chosen.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("parts"))
    about = sections.select("section_id", "doc_id", "title", "level_path", X.citation(F.col("page_printed_start"), F.col("page_printed_end")).alias("citation"))
    return results.join(about, "section_id").join(texts, "section_id", "left").select(
        *results.columns, "doc_id", "title", "level_path", "citation",
        F.transform("parts", lambda p: p["chunk_id"]).alias("chunk_ids"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"),
    )


def interleave(results: DataFrame) -> DataFrame:
    """Several sub-queries' results, in turn: ``place`` in ``run_id`` by rank, then ``subquery_no``."""
    order = W.partitionBy("run_id").orderBy("rank", "subquery_no")
    return results.withColumn("place", F.row_number().over(order))


def hybrid_search(queries: DataFrame, chunks: DataFrame, index: DataFrame | None, length_rows: DataFrame | None, vectors: DataFrame, limit: int = 5, pool: int = P.POOL) -> DataFrame:
    """``(query_id, rank, section_id, matched_chunk_id, score, keyword_only)``."""
    fused = fuse(keyword_search(queries, chunks, index, length_rows, pool), vector_search(queries, vectors, pool))
    flags = queries.select("query_id", F.col("embedding").isNull().alias("keyword_only"))
    return best_sections(fused, chunks, limit).join(flags, "query_id")
