"""Small pieces that several of the text jobs share."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of all contracts: runs of anything but space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all machines share.

    Only on one machine (a local master) a temporary folder takes its place if that is
    unset; on a cluster that would lose rows, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="leafquire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/leafquire-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = path or work_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def about(share: float, *keys: Column) -> Column:
    """Whether a row is in a sample of about ``share`` of all, picked by a hash of its keys."""
    whole = 1 << 50
    return F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(whole)) < math.ceil(min(1.0, share) * whole)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words: the places where a word character follows none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys and the seed alone."""
    parts = [F.coalesce(k.cast("string"), F.lit("\u0000")) for k in keys]
    digest = F.md5(F.concat_ws("\u0001", *parts, F.lit(seed)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def whole_groups(batches, keys: list[str]):
    """Arrow tables of complete groups from batches that are sorted by integer ``keys``.

    Yields ``(rows, starts)``: the rows of one or more groups and where each begins. Only
    the rows of a group that a batch's end cuts wait for the next batch.
    """
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = (now if rest is None else pa.concat_tables([rest, now])).combine_chunks()
        starts = _group_starts(now, keys)
        last = int(starts[-1])
        if last:
            yield now.slice(0, last), starts[:-1]
        rest = now.slice(last)
    if rest is not None:
        yield rest, _group_starts(rest, keys)


def _group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    values = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in keys])
    return np.flatnonzero(np.concatenate(([True], (values[:, 1:] != values[:, :-1]).any(0))))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(node, component)``.

    ``component`` is the smallest node reachable. Large-star and small-star steps
    alternate until the edges stop changing; each step's edges are written to the
    shared folder, so a lost executor costs one step and no table is collected.
    Edges with a null end and loops are ignored; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    state = None
    while True:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        large = large.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where(b != F.col("m")).select("b", F.col("m").alias("c"))
            .select(F.greatest("b", "c").alias("a"), F.least("b", "c").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after = materialize(small)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        discard(now)
        now = after
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
    nodes = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(b.alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    return nodes.unionByName(roots.withColumn("component", F.col("node")))
