"""Sharding by jump consistent hashing, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.llm.shared import fresh, table

SHARDS = 40
#: Rows of a shard are ordered by a hash of their key, in this many ranges of it, so no task
#: holds a whole shard. Slots do not depend on the number.
PARTS = 1024
#: A row that repeats more often than this is dealt to several tasks.
REPEATS = 1000
#: Fixed values of the published jump hash: the multiplier of its 64-bit generator.
MULTIPLIER = 2862933555777941757


def _jump(key: Column, shards: int) -> Column:
    """State after the last jump below ``shards``: ``b`` the shard, ``j`` the next jump.

    The generator runs modulo 2**64 in decimals, which cannot overflow. A jump
    moves on by one at least, so ``shards`` steps always suffice; steps after the
    last jump change nothing.
    """
    two_64, two_33 = F.lit(str(2**64)).cast("decimal(20,0)"), F.lit(2**33).cast("decimal(11,0)")
    unsigned = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(unsigned < 0, unsigned + two_64).otherwise(unsigned).cast("decimal(20,0)")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), unsigned.alias("k"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + 1) % two_64).cast("decimal(20,0)")
        span = ((k - k % two_33) / two_33).cast("double") + 1
        return F.when(
            s["j"] < shards,
            F.struct(
                s["j"].alias("b"),
                F.floor((s["j"] + 1).cast("double") * (F.lit(float(2**31)) / span)).alias("j"),
                k.alias("k"),
            ),
        ).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def assign(df: DataFrame, key: str, shards: int = SHARDS, into: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add each row's shard, and its shard if one more were appended.

    Only ``key`` (an integer; null counts as 0) and the shard count decide, so a row
    moves only into the new shard. All other columns stay; columns that carry the two
    new names are replaced. No shuffle.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    (state,) = fresh(df, "_jump")
    return (
        df.withColumn(state, _jump(F.col(key), shards))
        .withColumn(into, F.col(state)["b"].cast("int"))
        .withColumn(grown, F.when(F.col(state)["j"] == shards, F.lit(shards)).otherwise(F.col(state)["b"]).cast("int"))
        .drop(state)
    )


def _order(key: str) -> Column:
    """32 bits of a hash of the key: rows of a shard stand in this order."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, grown_shard and slot.

    ``size`` is the text's UTF-8 bytes plus 16 (null: 16), ``slot`` numbers the rows of
    a shard from 0 without gaps, in the order of a hash of the key. Equal rows are counted
    before they are dealt, so a key that repeats never fills one task; they take
    neighbouring slots, and many of them are written by many tasks. Ties cannot
    matter: rows that agree in key, size and checksum are interchangeable. Extra
    columns are not read; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    thin = df.select(F.col(key).alias("key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("crc"))
    groups = thin.groupBy("key", "size", "crc").agg(F.count("*").alias("n"))
    groups = assign(groups, "key", shards).withColumn("hash", _order("key")).withColumn("part", F.floor(F.col("hash") * parts / 2**32).cast("int"))
    # At most shards x parts rows, whatever the input: one small table of offsets.
    sums = groups.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard", "part").orderBy("hash", "key", "size", "crc").rowsBetween(W.unboundedPreceding, -1)
    placed = groups.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(sums), ["shard", "part"])
    placed = placed.select("key", "size", "crc", "shard", "grown_shard", "n", (F.col("base") + F.col("ahead")).alias("first"))
    few = placed.where(F.col("n") <= REPEATS)
    many = placed.where(F.col("n") > REPEATS).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))))
    many = many.withColumn("first", F.col("first") + F.col("at")).withColumn("n", F.least(F.lit(REPEATS), F.col("n") - F.col("at"))).drop("at").repartition("first")
    slots = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    return few.unionByName(many).select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "grown_shard", slots.alias("slot"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """Write the rows, with all their columns, to one folder per shard."""
    assign(df, key, shards).drop("grown_shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ledger(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
