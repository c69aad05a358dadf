"""Keyword index and batch keyword search by BM25 over phrases of two-letter terms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators.best import Best, allowed, in_blocks, strings
from leafquire.sources.stage import staged

#: Query terms up to this many go to every task; more queries are another block, or a join by shuffle.
BROADCAST_TERMS = 200_000
#: Parts of scores that a task holds at once.
PARTS_AT_ONCE = 2_000_000


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(chunk_id, pos, gram)``: a row for each term of each chunk. No shuffle."""
    return chunks.select(F.col(key).alias("chunk_id"), F.posexplode(X.grams(F.col(text))).alias("pos", "gram"))


def lengths(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(chunk_id, n)``: terms per chunk, empty chunks included."""
    return chunks.select(F.col(key).alias("chunk_id"), F.size(X.grams(F.col(text))).alias("n"))


def write_postings(rows: DataFrame, table: str, buckets: int = 200) -> None:
    """Store postings bucketed and sorted by term, so that later joins need no shuffle of them."""
    rows.write.mode("overwrite").bucketBy(buckets, "gram").sortBy("gram", "chunk_id").saveAsTable(table)


def query_phrases(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """``(query_id, phrase_no, phrase)``: a query's words as arrays of terms; no words, no rows."""
    return queries.select(F.col(key).alias("query_id"), F.posexplode(X.phrases(F.col(text))).alias("phrase_no", "phrase"))


def phrase_matches(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """``(phrase, chunk_id, f)``: how often each distinct phrase stands in each chunk.

    A phrase stands where its terms follow each other, also over the end of a word.
    Phrases of several queries are matched once. Only places of a phrase's rarest term
    become candidates; its other terms are then looked up at their places beside it.
    """
    known = phrases.select("phrase").where(F.size("phrase") > 0).distinct().withColumn("id", F.xxhash64("phrase"))
    terms = staged(known.select("id", F.size("phrase").alias("need"), F.posexplode("phrase").alias("off", "gram")))
    near = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda df: df)
    held = index.join(near(terms.select("gram").distinct()), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = terms.join(often, "gram").groupBy("id", "need").agg(F.min(F.struct("n", "off", "gram")).alias("a")).select("id", "need", "a.off", "a.gram")
    places = held.join(near(rarest), "gram").select("id", "need", "chunk_id", (F.col("pos") - F.col("off")).alias("at"))
    wanted = places.where("need > 1").join(near(terms.drop("need")), "id").select("id", "need", "chunk_id", "at", "gram", (F.col("at") + F.col("off")).alias("pos"))
    whole = wanted.join(held, ["chunk_id", "pos", "gram"]).groupBy("id", "need", "chunk_id", "at").agg(F.count("*").alias("got")).where("got = need")
    found = places.where("need = 1").select("id", "chunk_id").unionByName(whole.select("id", "chunk_id"))
    return found.groupBy("id", "chunk_id").agg(F.count("*").alias("f")).join(known, "id").select("phrase", "chunk_id", "f")


def phrase_tree(phrases: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """A prefix tree: its terms, sorted keys ``state * (terms + 1) + term``, the states they lead to, and each state's phrase or -1."""
    names = sorted({g for p in phrases for g in p})
    code = {g: i for i, g in enumerate(names)}
    links: dict[int, int] = {}
    ends = [-1]
    for i, p in enumerate(phrases):
        state = 0
        for g in p:
            state = links.setdefault(state * (len(names) + 1) + code[g], len(ends))
            if state == len(ends):
                ends.append(-1)
        ends[state] = i
    keys = np.array(sorted(links), np.int64)
    return names, keys, np.array([links[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64)


def matches_in(every: list[list[str]], chunks: DataFrame) -> DataFrame:
    """``(chunk_id, doc_id, content_type, n, ids, f)``: each chunk with its length and the phrases of ``every`` in it.

    From each place the phrases' prefix tree is walked, so no row is made for a place
    and a phrase that only share a term. A map over the chunks; ``every`` is bounded.
    """
    tree = chunks.sparkSession.sparkContext.broadcast(phrase_tree(every))
    rows = chunks.select("chunk_id", "doc_id", "content_type", X.grams(F.col("text")).alias("gs"))

    def run(batches):
        names, keys, to, ends = tree.value
        names = pa.array(names, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                gs = part.column("gs")
                size = pc.fill_null(pc.list_value_length(gs), 0).to_numpy(zero_copy_only=False)
                codes = pc.fill_null(pc.index_in(gs.flatten(), value_set=names), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                end = np.cumsum(size)[row]
                pos, k, found = np.arange(len(codes) if len(keys) else 0), 0, []
                state = np.zeros(len(pos), np.int64)
                while len(pos):
                    want = state * (len(names) + 1) + codes[pos + k]
                    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    good = keys[at] == want
                    pos, state, k = pos[good], to[at[good]], k + 1
                    done = ends[state] >= 0
                    found.append(row[pos[done]] * len(ends) + ends[state[done]])
                    inside = pos + k < end[pos]
                    pos, state = pos[inside], state[inside]
                pairs, f = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(len(size) + 1) * len(ends)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % len(ends), f)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("chunk_id", "doc_id", "content_type")], pa.array(size.astype(np.int32)), *lists], names=["chunk_id", "doc_id", "content_type", "n", "ids", "f"])

    return rows.mapInArrow(run, "chunk_id string, doc_id string, content_type string, n int, ids array<int>, f array<int>")


def best_in(asked: list, find, k: int, statistics: tuple[int, float] | None, spark) -> DataFrame:
    """``(query_id, chunk_id, score)``: each task's best ``k`` chunks for a bounded block of queries.

    One pass, ``find(phrases)``, finds the phrases as ``matches_in`` does, and how many chunks hold each is counted
    over all chunks, before any filter; a second pass over these short rows sums the
    scores of all queries at once. A query's parts are added in ascending order, so
    equal chunks tie in every run. Only the best of each task are shuffled.
    """
    numbers: dict[tuple, int] = {}
    uses: list[list[int]] = []
    for q, row in enumerate(asked):
        for phrase in row.phrases:
            i = numbers.setdefault(tuple(phrase), len(uses))
            if i == len(uses):
                uses.append([])
            uses[i].append(q)
    held = staged(find([list(p) for p in numbers]))
    n, avg = statistics or corpus(held)
    holders = held.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n_chunks"))
    idf = np.zeros(len(uses))
    for r in holders.collect():  # at most one row a phrase of the block
        idf[r.id] = max(math.log((n - r.n_chunks + 0.5) / (r.n_chunks + 0.5)), 0.0) or P.BM25_LEAST_IDF
    degree = np.array([len(u) for u in uses], np.int64)
    model = spark.sparkContext.broadcast((
        [r.query_id for r in asked], [(r.doc_id, r.content_type) for r in asked], idf, degree, np.cumsum(degree) - degree, np.array([q for u in uses for q in u], np.int64), avg or 1.0))

    def run(batches):
        ids, limits, idf, degree, first, of, avg = model.value
        best = Best(len(ids), k)
        for batch in batches:
            phrase, f = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "f"))
            size = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            relative = batch.column("n").to_numpy()[row] / avg
            part = idf[phrase] * f * (P.BM25_K1 + 1) / (f + P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * relative))
            order = np.lexsort((part, row))
            phrase, part = phrase[order], part[order]
            names, passes = strings(batch.column("chunk_id")), allowed(batch, limits)
            cost = np.bincount(row, degree[phrase], batch.num_rows).cumsum() // PARTS_AT_ONCE
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(cost)) + 1):
                lo, hi = np.searchsorted(row, (rows[0], rows[-1] + 1)) if len(rows) else (0, 0)
                times = degree[phrase[lo:hi]]
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                query = of[np.repeat(first[phrase[lo:hi]], times) + step]
                score = -np.bincount(np.repeat(row[lo:hi] - rows[0], times) * len(ids) + query, np.repeat(part[lo:hi], times), len(rows) * len(ids)).reshape(len(rows), -1) if len(rows) else np.empty((0, len(ids)))
                for q in np.flatnonzero((score < 0).any(0)).tolist():
                    good = (score[:, q] < 0) & (score[:, q] <= best.limit(q))
                    good &= True if passes[q] is None else passes[q][rows]
                    if good.any():
                        best.add(q, score[good, q], names[rows[good]])
        yield best.rows(ids, "score")

    return held.mapInArrow(run, "query_id string, chunk_id string, score double")


def corpus(length_rows: DataFrame) -> tuple[int, float]:
    """Number of chunks and mean length, over the whole corpus."""
    row = length_rows.agg(F.count("*").alias("n"), F.avg("n").alias("avg")).first()
    return row["n"], float(row["avg"] or 0.0)


def bm25(phrases: DataFrame, matches: DataFrame, length_rows: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score)``, the best most negative; a repeated word counts twice.

    The number of chunks that hold a phrase is counted over all chunks, before any
    filter of a query.
    """
    n, avg = corpus(length_rows)
    holders = matches.groupBy("phrase").agg(F.count("*").alias("n_chunks"))
    idf = F.log((n - F.col("n_chunks") + 0.5) / (F.col("n_chunks") + 0.5))
    weights = holders.select("phrase", F.when(idf <= 0, P.BM25_LEAST_IDF).otherwise(idf).alias("idf"))
    f, relative = F.col("f"), F.col("n") / (avg or 1.0)
    part = F.col("idf") * f * (P.BM25_K1 + 1) / (f + P.BM25_K1 * (1 - P.BM25_B + P.BM25_B * relative))
    scored = matches.join(length_rows, "chunk_id").join(weights, "phrase").select("phrase", "chunk_id", part.alias("part"))
    parts = phrases.join(scored, "phrase").groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    # A query has few phrases; in a fixed order equal parts give equal sums, so ties stay ties.
    return parts.select("query_id", "chunk_id", (-F.aggregate("parts", F.lit(0.0), lambda s, x: s + x)).alias("score"))


def keep_allowed(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits that pass their query's ``doc_id`` and ``content_type``; a null filter lets all pass."""
    limits = queries.select("query_id", F.col("doc_id").alias("want_doc"), F.col("content_type").alias("want_type")).where("want_doc IS NOT NULL OR want_type IS NOT NULL")
    about = chunks.select("chunk_id", F.col("doc_id").alias("has_doc"), F.col("content_type").alias("has_type"))
    limited = hits.join(limits, "query_id").join(about, "chunk_id").where(
        (F.col("want_doc").isNull() | (F.col("want_doc") == F.col("has_doc"))) & (F.col("want_type").isNull() | (F.col("want_type") == F.col("has_type")))
    )
    return hits.join(limits, "query_id", "left_anti").unionByName(limited.select(*hits.columns))


def top(hits: DataFrame, k: int, order: str = "score", key: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The first ``k`` rows of each query by ``order`` ascending, then ``tie``; ``rank`` from 1."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(order, tie))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_search(queries: DataFrame, chunks: DataFrame, index: DataFrame | None = None, length_rows: DataFrame | None = None, k: int = P.POOL) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: filters first, then the cut.

    Without an index the chunks themselves are searched, for blocks of queries; with one
    (postings, bucketed by term) only the places of the queries' terms are read.
    """
    if index is not None:
        phrases = query_phrases(queries)
        # Matches are counted and then scored: written once, so the postings are read once.
        matches = staged(phrase_matches(phrases, index))
        return top(keep_allowed(bm25(phrases, matches, lengths(chunks) if length_rows is None else length_rows), queries, chunks), k)
    asked = queries.select("query_id", X.phrases(F.col("query")).alias("phrases"), "doc_id", "content_type").where(F.size("phrases") > 0)
    statistics = None if length_rows is None else corpus(length_rows)
    found = chunks.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double")
    for block in in_blocks(asked, BROADCAST_TERMS, lambda r: sum(map(len, r.phrases))):
        found = found.unionByName(best_in(block, lambda every: matches_in(every, chunks), k, statistics, chunks.sparkSession))
    return top(found, k)


def find_forms(queries: DataFrame, chunks: DataFrame, index: DataFrame | None = None, length_rows: DataFrame | None = None, k: int = 5) -> DataFrame:
    """The best form entries for each query."""
    only = queries.withColumn("content_type", F.lit("form_index"))
    return keyword_search(only, chunks, index, length_rows, k).join(chunks, "chunk_id")
