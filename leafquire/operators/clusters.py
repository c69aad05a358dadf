"""Exact nearest vectors from stored clusters: vectors that cannot be near enough are not read.

A vector lies with its nearest pivot, in blocks of up to ``WIDTH`` vectors of like distance
to it. By the triangle inequality a block whose vectors lie ``lo`` to ``hi`` from a pivot
holds nothing within ``t`` of a query that is ``d`` from the pivot, unless ``d - t <= hi``
and ``d + t >= lo``. A first round looks at the nearest clusters that hold ``k`` vectors a
query may take; the ``k``-th distance then tells which others can matter. Queries are
never gathered in the driver: tasks pack them by cluster and the packs meet the blocks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators.best import Best, allowed, strings
from leafquire.operators.keyword import top
from leafquire.operators.search import SLACK
from leafquire.sources.stage import staged

#: Pivots are fitted on at most this many vectors, picked by hash; all vectors are stored.
SAMPLE = 20_000
#: Pivots, which tasks hold as one matrix; else the square root of the number of vectors.
MOST_CLUSTERS = 2048
#: Folders of a store: their names are all that a search lists in the driver.
PARTS = 256
#: Vectors of a block, and queries of a pack.
WIDTH = 64
#: Queries whose best rows a task holds before it passes them on.
HELD = 2048

BLOCK = "cluster int, lo double, hi double, chunk_id array<string>, doc_id array<string>, content_type array<string>, v array<double>, part int"
PIVOT = "cluster int, part int, n bigint, lo double, hi double, pivot array<double>"
COUNT = "key string, held array<struct<cluster:int,n:bigint>>"
PACK = (
    "cluster int, part int, lo double, hi double, query_id array<string>, want_doc array<string>, want_type array<string>, "
    "q array<double>, q_lo array<double>, q_hi array<double>"
)
HIT = "query_id string, chunk_id string, distance double"


class Store(NamedTuple):
    blocks: DataFrame
    pivots: DataFrame
    counts: DataFrame


def _units(vectors: DataFrame, name: str) -> DataFrame:
    """Vectors at length one; null, zero and non-finite ones are left out."""
    v = X.unit(F.col("embedding").cast("array<double>"))
    return vectors.select(name, v.alias("v"), "doc_id", "content_type").where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x))")


def _matrix(batch, column: str = "v") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows of two matrices, right to about 1e-7."""
    square = lambda x: np.einsum("ij,ij->i", x, x)
    return np.sqrt(np.maximum(0.0, square(a)[:, None] + square(b)[None] - 2.0 * (a @ b.T)))


def fit(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """At most ``n`` pivots: means of the sample's groups, from evenly spaced different rows."""
    rows = np.unique(sample, axis=0)
    pivots = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)] if len(rows) else rows
    for _ in range(rounds if len(pivots) > 1 else 0):
        at = np.concatenate([distances(sample[i : i + 1024], pivots).argmin(1) for i in range(0, len(sample), 1024)])
        count = np.bincount(at, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, at, sample)
        pivots = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], pivots)
    return pivots


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_CLUSTERS rows

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                d = distances(_matrix(part), shared.value)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=[*part.schema.names, "cluster", "to_pivot"])

    return rows.mapInArrow(run, "chunk_id string, v array<double>, doc_id string, content_type string, cluster int, to_pivot double")


def _blocks(placed: DataFrame, n_clusters: int, width: int) -> DataFrame:
    """Rows in order of cluster and distance, as blocks. A cluster of any size is many tasks and files."""
    order = ["cluster", "to_pivot", "chunk_id"]
    rows = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = min(PARTS, n_clusters)

    def run(batches):
        for batch in batches:
            cluster, to_pivot = (batch.column(c).to_numpy() for c in ("cluster", "to_pivot"))
            edges = np.flatnonzero(np.diff(cluster)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                for start in range(a, b, width):
                    piece = batch.slice(start, min(width, b - start))
                    c, d = int(cluster[start]), to_pivot[start : start + piece.num_rows]
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c], pa.int32()), pa.array([d[0]]), pa.array([d[-1]]), *(one(piece.column(x)) for x in ("chunk_id", "doc_id", "content_type")),
                         one(piece.column("v").flatten()), pa.array([c * parts // n_clusters], pa.int32())],
                        names=["cluster", "lo", "hi", "chunk_id", "doc_id", "content_type", "v", "part"])

    return rows.mapInArrow(run, BLOCK)


def _key(doc, kind):
    """What a query asks for, or a row can be asked by; nulls ask for nothing."""
    return F.to_json(F.struct(doc.alias("d"), kind.alias("c")))


def write_clusters(vectors: DataFrame, path: str, clusters: int | None = None, width: int = WIDTH) -> None:
    """Store ``vectors(chunk_id, embedding, doc_id, content_type)`` by cluster.

    All vectors must have one number of parts. Null, zero and non-finite ones are left
    out; repeated rows are stored each. ``path`` must be new, and pivots are written last:
    a run that fails leaves no store that can be read, and no old one is touched.
    """
    spark, rows = vectors.sparkSession, _units(vectors, "chunk_id")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("v").collect()  # at most SAMPLE rows
    pivots = fit(np.array([r.v for r in sample]) if sample else np.empty((0, 1)), clusters or max(1, min(MOST_CLUSTERS, math.isqrt(n))))
    blocks = _blocks(_placed(rows, pivots), len(pivots), width) if len(pivots) else spark.createDataFrame([], BLOCK)
    blocks.write.partitionBy("part").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")

    each = blocks.select("cluster", F.explode(F.arrays_zip("doc_id", "content_type")).alias("x")).groupBy("cluster", "x.doc_id", "x.content_type").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    d, c = F.col("doc_id"), F.col("content_type")
    keys = F.filter(F.array_distinct(F.array(_key(d, c), _key(d, none), _key(none, c))), lambda x: x != "{}")
    held = each.select("cluster", "n", F.explode(keys).alias("key")).groupBy("key", "cluster").agg(F.sum("n").alias("n"))
    # At most MOST_CLUSTERS entries a key.
    held.groupBy("key").agg(F.collect_list(F.struct("cluster", "n")).alias("held")).write.parquet(f"{path}/counts")

    sizes = blocks.groupBy("cluster", "part").agg(F.sum(F.size("chunk_id")).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    centres = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cluster int, pivot array<double>")
    sizes.join(F.broadcast(centres), "cluster").select("cluster", "part", "n", "lo", "hi", "pivot").coalesce(1).write.parquet(f"{path}/pivots")


def read_clusters(spark, path: str) -> Store:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Store(read("blocks", BLOCK), read("pivots", PIVOT), read("counts", COUNT))


def _asked(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """Queries with the number of vectors that each cluster has for them (null: all of it).

    Queries that no vector passes are left out. Only queries with a filter are joined.
    """
    rows = _units(queries, "query_id")
    free = F.col("doc_id").isNull() & F.col("content_type").isNull()
    some = rows.where(~free).withColumn("key", _key(F.col("doc_id"), F.col("content_type"))).join(counts, "key").drop("key")
    return rows.where(free).withColumn("held", F.lit(None).cast("array<struct<cluster:int,n:bigint>>")).unionByName(some)


def _packs(asked: DataFrame, pivots: DataFrame, k: int, first: bool) -> DataFrame:
    """Queries packed by the clusters they are to be held against.

    In the first round these are a query's nearest clusters with ``k`` vectors for it; in
    the second all others that can hold a vector within ``most``, each with the distances
    from the pivot that count.
    """
    rows = pivots.orderBy("cluster").collect()  # at most MOST_CLUSTERS rows
    if not rows:
        return asked.sparkSession.createDataFrame([], PACK)
    table = {c: np.array([r[c] for r in rows]) for c in ("cluster", "part", "n", "lo", "hi", "pivot")}
    shared = asked.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        t = shared.value
        place = {c: i for i, c in enumerate(t["cluster"].tolist())}
        for batch in batches:
            for start in range(0, batch.num_rows, WIDTH):
                part = batch.slice(start, WIDTH)
                v = _matrix(part)
                far = distances(v, t["pivot"])
                held = part.column("held").to_pylist()
                most = np.full(len(v), np.inf) if first else np.array([np.inf if x is None else x + SLACK for x in part.column("most").to_pylist()])
                members = defaultdict(list)
                for i in range(len(v)):
                    n = t["n"]
                    if held[i] is not None:
                        n = np.zeros(len(n), np.int64)
                        for h in held[i]:
                            n[place[h["cluster"]]] = h["n"]
                    order = np.argsort(far[i], kind="stable")
                    order = order[n[order] > 0]
                    home = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
                    if first:
                        chosen = order[:home]
                    else:
                        rest = order[home:]
                        chosen = rest[(far[i, rest] - most[i] <= t["hi"][rest]) & (far[i, rest] + most[i] >= t["lo"][rest])]
                    for c in chosen.tolist():
                        members[c].append(i)
                ids, docs, kinds = (part.column(c).to_pylist() for c in ("query_id", "doc_id", "content_type"))
                out, size = [], 0
                for c, at in members.items():
                    lo, hi = far[at, c] - most[at], far[at, c] + most[at]
                    out.append((int(t["cluster"][c]), int(t["part"][c]), lo.min(), hi.max(), [ids[i] for i in at], [docs[i] for i in at], [kinds[i] for i in at], v[at].ravel(), lo, hi))
                    size += len(at)
                    if size > 4096:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    return asked.mapInArrow(run, PACK)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.list_(pa.string())] * 3, *[pa.list_(pa.float64())] * 3]
    names = ["cluster", "part", "lo", "hi", "query_id", "want_doc", "want_type", "q", "q_lo", "q_hi"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _meet(packs: DataFrame, blocks: DataFrame, columns) -> DataFrame:
    """Packs beside the blocks of their cluster that lie at a distance that counts.

    Folders without such a block are not opened, and other blocks are left out before the
    shuffle by the widest range of each cluster.
    """
    wide = packs.groupBy("cluster").agg(F.min("part").alias("in_part"), F.min("lo").alias("from"), F.max("hi").alias("to"))
    parts = [r.in_part for r in wide.select("in_part").distinct().collect()]  # at most PARTS numbers
    read = blocks.where(F.col("part").isin(parts)).select("part", "cluster", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), *columns)
    read = read.join(F.broadcast(wide), "cluster").where("b_hi >= from AND b_lo <= to").drop("part", "in_part", "from", "to")  # wide: at most MOST_CLUSTERS rows
    return read.join(packs, "cluster").where("b_hi >= lo AND b_lo <= hi")


def _hits(packs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Each task's nearest ``k`` of the queries it meets; exact distances."""
    met = _meet(packs, blocks, ["chunk_id", "doc_id", "content_type", "v"])
    columns = ["b_lo", "b_hi", "chunk_id", "doc_id", "content_type", "v", "query_id", "want_doc", "want_type", "q", "q_lo", "q_hi"]

    def run(batches):
        best: dict[str, Best] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in columns}
                inside = pa.RecordBatch.from_arrays([row[c].values for c in ("chunk_id", "doc_id", "content_type")], names=["chunk_id", "doc_id", "content_type"])
                ids = row["query_id"].as_py()
                v = row["v"].values.to_numpy(zero_copy_only=False).reshape(inside.num_rows, -1)
                q = row["q"].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                names, passes = strings(inside.column("chunk_id")), allowed(inside, list(zip(row["want_doc"].as_py(), row["want_type"].as_py())))
                about = distances(q, v)
                lo, hi = (row[c].values.to_numpy(zero_copy_only=False) for c in ("q_lo", "q_hi"))
                for i in np.flatnonzero((row["b_hi"].as_py() >= lo) & (row["b_lo"].as_py() <= hi)).tolist():
                    mine = best.setdefault(ids[i], Best(1, k))
                    at = np.arange(len(v)) if passes[i] is None else np.flatnonzero(passes[i])
                    at = at[about[i, at] <= mine.limit(0) + SLACK]
                    diff = v[at] - q[i]
                    mine.add(0, np.sqrt(np.einsum("ij,ij->i", diff, diff)), names[at])
                if len(best) > HELD:
                    yield from (b.rows([name], "distance") for name, b in best.items())
                    best = {}
        yield from (b.rows([name], "distance") for name, b in best.items())

    return met.select(*columns).mapInArrow(run, HIT)


def _rounds(queries: DataFrame, store: Store, k: int):
    """The packs of both rounds, and the first round's hits."""
    asked = staged(_asked(queries, store.counts))
    one = staged(_packs(asked, store.pivots, k, True))
    near = staged(top(_hits(one, store.blocks, k), k, "distance"))
    most = near.where(F.col("rank") == k).select("query_id", F.col("distance").alias("most"))
    two = staged(_packs(asked.join(most, "query_id", "left"), store.pivots, k, False))
    return one, two, near.drop("rank")


def search(queries: DataFrame, store: Store, k: int = P.POOL) -> DataFrame:
    """``search.vector_search`` over stored clusters: the same rows, distances and ranks.

    Queries have different ids; null ids are no queries. Equal distances go by
    ``chunk_id``. An empty store or query table gives no rows.
    """
    _one, two, near = _rounds(queries.where("query_id IS NOT NULL"), store, k)
    return top(near.unionByName(_hits(two, store.blocks, k)), k, "distance")


def compared(queries: DataFrame, store: Store, k: int = P.POOL) -> DataFrame:
    """``(query_id, n)``: with how many stored vectors a query is compared, in both rounds."""
    one, two, _near = _rounds(queries.where("query_id IS NOT NULL"), store, k)
    met = _meet(one.unionByName(two), store.blocks, [F.size("chunk_id").alias("size")])
    each = met.select("size", "b_lo", "b_hi", F.explode(F.arrays_zip("query_id", "q_lo", "q_hi")).alias("x")).where("b_hi >= x.q_lo AND b_lo <= x.q_hi")
    return each.groupBy("x.query_id").agg(F.sum("size").alias("n"))
