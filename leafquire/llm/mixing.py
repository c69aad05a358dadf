"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.llm.shared import fresh, materialize, table, uniform, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = "leafquire-mix"
#: Key ranges per source. Only the range that holds a source's budget line is sorted.
RANGES = 4096


def quality(text: Column) -> Column:
    """Sampling weight in [0.1, 1]: the share of characters that are not punctuation or marks."""
    body = F.coalesce(text, F.lit(""))
    marks = F.length(body) - F.length(F.translate(body, "#*$%&|<>!_=~^\\{}[]@", ""))
    return F.lit(1.0) - 0.9 * F.least(F.lit(1.0), 4.0 * marks / F.greatest(F.length(body), F.lit(1)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    Sources are ordered by code point, null last, and take ``weights`` in turn. They
    share ``share`` of all sizes by weight; no target passes ``most`` times its source's
    size, and what it cannot take is shared again by weight. Sharing again until none is
    above ends at one level: sources in the order of cap over weight are capped as long
    as the level left for the others reaches them. The table has one row per source, not
    per document, so its windows stay small.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("w", F.get(F.array(*map(F.lit, weights)), turn)).withColumn("cap", most * F.col("source_size"))
    by_ratio = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("w") * F.col("level") <= F.col("cap"))
    water = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(everything)
    return ranked.withColumn("water", water["level"]).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("water")), F.col("cap")).cast("double").alias("target"),
    )


def measure(df: DataFrame, key: str, text: str, weight: str | None, seed: str, ranges: int) -> DataFrame:
    """Add ``size``, the sampling key ``mix_key`` and its range ``mix_range``: a map, no shuffle.

    The chance behind a sampling key depends on the row's key and text, so rows that share
    a key, or have none, do not share a range.
    """
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(1e-6)) if weight else quality(F.col(text))
    k = F.col("mix_key")
    return (
        df.withColumn("size", word_count(F.col(text)))
        .withColumn("mix_key", -F.log(uniform(seed, F.col(key), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))) / w)
        .withColumn("mix_range", F.floor(k / (1 + k) * ranges).cast("int"))  # monotone in the key
    )


def budget_lines(measured: DataFrame, source: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per source: target, whole epochs, the rest, and the range where the rest runs out."""
    sums = measured.groupBy(F.col(source).alias("source"), "mix_range").agg(F.sum("size").alias("here"))
    per_source = targets(sums.groupBy("source").agg(F.sum("here").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per_source = per_source.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - epochs * F.col("source_size")).cast("long"))
    upto = W.partitionBy("own").orderBy("mix_range").rowsBetween(W.unboundedPreceding, 0)
    own = sums.withColumnRenamed("source", "own").withColumn("upto", F.sum("here").over(upto))
    line = F.when(F.col("upto") > F.col("rest"), F.struct(F.col("mix_range").alias("at"), (F.col("upto") - F.col("here")).alias("ahead")))
    return (
        own.join(per_source, F.col("own").eqNullSafe(F.col("source")))
        .groupBy("source", "source_size", "target", "epochs", "rest")
        .agg(F.min(line).alias("line"))
    )


def decide(measured: DataFrame, lines: DataFrame, key: str, source: str, split: bool) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken``.

    Rows outside their source's line range are decided by that range alone, without a
    shuffle; rows in it (about one in ``ranges``) are sorted within their source.
    """
    few = lines.count() <= 100_000  # beyond that many sources Spark shuffles instead
    lines = lines.withColumnRenamed("source", "mix_source").drop("size")
    joined = measured.join(F.broadcast(lines) if few else lines, F.col(source).eqNullSafe(F.col("mix_source")))
    at = F.coalesce(F.col("line.at"), F.lit(2**31 - 1))
    on_line = F.col("mix_range") == at
    sure = joined.where(~on_line).withColumn("mix_part", F.when(F.col("mix_range") < at, F.col("size")).otherwise(0))
    within = W.partitionBy(source).orderBy("mix_key", "size", key).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("line.ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    fits = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    part = fits if split else F.when(2 * fits >= F.col("size"), F.col("size")).otherwise(0)
    rows = sure.unionByName(joined.where(on_line).withColumn("mix_part", part))
    return rows.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("mix_part")).cast("long")).drop(
        "mix_source", "mix_part", "mix_key", "mix_range", "epochs", "rest", "line"
    )


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None,
    weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED, ranges: int = RANGES, split: bool = True,
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted) to each row.

    A target holds whole epochs of its source plus a rest. All documents are taken once
    for each epoch; the rest goes to documents in the order of their keys ``-ln(u) / w``,
    where ``u`` depends on key, text and seed alone, so reruns agree. Keys are summed by ranges
    (at most sources x ``ranges`` sums); only the range with a source's budget line is
    sorted, so a source with a third of all rows is not one task. The document on the
    line gives the words that still fit if ``split``, else all of them if at least half
    of them fit. Null texts have size 0 and take 0; a null source is a source; rows with
    equal sampling keys are ordered by size. Other columns stay, those with the new names or with
    names that begin with ``mix_`` are replaced. An empty table gives no rows.
    """
    own = {"source_size", "target", "taken", "mix_source", "mix_part", "mix_key", "mix_range", "epochs", "rest", "line"} - {key, text, source, weight}
    # Written once with the texts, which are measured once; both later steps read it.
    measured = materialize(measure(df.drop(*own), key, text, weight, seed, ranges))
    lines = materialize(budget_lines(measured, source, weights, share, most))
    return decide(measured, lines, key, source, split)


def repeat(mixed: DataFrame) -> DataFrame:
    """One row for each time the mix takes a document as a whole."""
    (n,) = fresh(mixed, "_n")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn(n, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).drop(n)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = measure(table(spark, sf_dir, "documents"), "doc_id", "text", None, SEED, RANGES)
    docs = materialize(docs.select("doc_id", "source", "size", "mix_key", "mix_range"))
    lines = materialize(budget_lines(docs, "source"))
    return decide(docs, lines, "doc_id", "source", True).select("doc_id", "size", "source_size", "target", "taken")
