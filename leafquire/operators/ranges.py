"""Ordered passes over groups of any size.

Rows are dealt by range of their order, so one group may be many tasks; what a range hands
on to the next is summed up in a row, and the sums are composed in order.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leafquire.sources.stage import staged

#: Words of 64 flags up to this many go to every task; more are joined by shuffle.
BROADCAST_FLAGS = 1_000_000


def numbered(df: DataFrame, into: str, **options) -> DataFrame:
    """``df``, written once, with a number ``into`` for each row that stays the same wherever it is read."""
    return staged(df.withColumn(into, F.monotonically_increasing_id()), **options)


def rows_of(df: DataFrame, wanted: DataFrame, number: str = "_row") -> DataFrame:
    """The rows of ``df`` whose number stands in ``wanted``, which may repeat it.

    The numbers go as one bit each to where ``df`` is read, so the other rows are never shuffled.
    """
    word, bit = F.shiftright(number, 6), F.col(number).bitwiseAND(63).cast("int")
    flags = staged(wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({number} & 63))")).alias("_bits")))
    near = F.broadcast if flags.count() <= BROADCAST_FLAGS else (lambda x: x)
    return df.withColumn("_word", word).join(near(flags), "_word").where(F.getbit("_bits", bit) == 1).drop("_word", "_bits")


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """``df`` by range of ``order``, with the range's number ``_part``; rows equal in ``order`` share one."""
    return staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def reaching(sums: DataFrame, by: list[str]) -> DataFrame:
    """Of ``sums`` (a row for each group and range) those of groups that lie in several ranges.

    A range shares at most its first and its last group with others, so these are at most
    two rows a range, whatever the number of groups: small enough to broadcast.
    """
    n = F.count("*").over(W.partitionBy(*by))
    return sums.withColumn("_n", n).where("_n > 1").drop("_n")


def hand_over(df: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with what ``sums`` says of its group and range; nulls for groups of one range."""
    right = sums.select("_part", *[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in sums.columns if c not in ("_part", *by)])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    on = right.withColumnRenamed("_part", "_of")
    met = F.col("_part") == F.col("_of")
    for s in same:
        met = met & s
    return df.join(F.broadcast(on), met, "left").drop("_of", *[f"_by_{c}" for c in by])


def counted_before(df: DataFrame, by: list[str], order: str, value: str, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the same ``by`` before this one in ``order``.

    ``df`` is dealt by ``by`` and ``order``. Null values count as 0.
    """
    inside = W.partitionBy("_part", *by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*by, "_part").agg(F.sum(value).alias("_here"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = reaching(sums, by).withColumn("_ahead", F.sum("_here").over(before)).drop("_here")
    rows = hand_over(df.withColumn("_mine", F.sum(value).over(inside)), sums, by)
    return rows.withColumn(into, F.coalesce("_mine", F.lit(0)) + F.coalesce("_ahead", F.lit(0))).drop("_mine", "_ahead")


def outcomes(sizes: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """What packing these sizes does to any group that is still open before them.

    ``(held, starts, tail)``: entry ``i`` is for an open group with room for ``held[i]`` but
    not for ``held[i + 1]``. ``starts`` new groups begin here and the last one holds
    ``tail``; where no group begins, the open one grows by all, ``tail``. Entry 0 is for
    no group, or one without room even for nothing. At most ``limit + 2`` entries.
    """
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    n = len(sizes)
    # Where a group ends that begins at each place: as far as the sum fits, one element at least.
    ends = np.maximum(np.arange(n) + 1, np.searchsorted(upto, upto[:-1] + limit, side="right") - 1).tolist()
    starts, last = [0] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        end = ends[i]
        starts[i], last[i] = (1, i) if end >= n else (1 + starts[end], last[end])
    total = int(upto[n])
    held, begun, tail = [-1], [starts[0]], [total - int(upto[last[0]])]
    for at in range(int(np.searchsorted(upto, limit, side="right"))):
        if held[-1] == int(upto[at]):  # nothing between: the later place counts
            held.pop(), begun.pop(), tail.pop()
        held.append(int(upto[at]))
        begun.append(starts[at])
        tail.append(total if at == n else total - int(upto[last[at]]))
    return held, begun, tail


def after(state: tuple[int, int] | None, outcome, limit: int) -> tuple[int, int]:
    """``(sum, number)`` of the open group after a range with ``outcome``, from that before it."""
    held, starts, tail = outcome
    if state is None:
        return tail[0], starts[0] - 1
    at = max(bisect_right(held, limit - state[0]) - 1, 0)
    if starts[at] == 0:
        return min(state[0] + tail[at], limit + 1), state[1]
    return tail[at], state[1] + starts[at]


def packed(df: DataFrame, by: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """Add ``run``: rows of each ``by``, in ``order``, in groups from 0 whose sizes sum up to ``limit`` at most.

    A row joins the open group if it fits, else it begins the next; one row alone may be larger.
    A group that began in one range may end in another: a range says for each room that may be
    left before it how it ends (``outcomes``), these are composed in order on the driver
    (one row a range, at most ``limit + 2`` entries), and each range starts from the sum
    that is open before it.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", F.to_json(F.struct(*by)))
    rows = dealt(keyed, *by, *order)
    start = spark.sparkContext.broadcast(_open_before(rows, by, order, size, limit))
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("_key", "_part")] + [T.StructField("run", T.IntegerType())])

    def run(batches):
        last, state = None, None
        for batch in batches:
            groups = []
            for part, key, n in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", size))):
                if last != (part, key):
                    known = start.value.get(part)
                    begins = last is None or last[0] != part
                    state = known[1] if begins and known is not None and known[0] == key else None
                    last = part, key
                n = n or 0
                if state is None:
                    state = n, 0
                elif state[0] + n > limit:
                    state = n, state[1] + 1
                else:
                    state = state[0] + n, state[1]
                groups.append(state[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(groups, pa.int32())], names=schema.names)

    return rows.repartition("_part").sortWithinPartitions("_part", *by, *order).mapInArrow(run, schema)


def _open_before(rows: DataFrame, by: list[str], order: list[str], size: str, limit: int) -> dict:
    """For each range the group of ``by`` that goes on into it, with the sum and number that are open there."""

    def summed(part, first, last, head, tail):
        out = outcomes(np.asarray(head), limit)
        return part, first, last, *out, *(after(None, outcomes(np.asarray(tail), limit), limit) if last != first else (None, None))

    def run(batches):
        found, part, first, last, head, tail = [], None, None, None, [], []
        for batch in batches:
            for p, key, n in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", size))):
                if p != part:
                    if part is not None:
                        found.append(summed(part, first, last, head, tail))
                    part, first, last, head, tail = p, key, key, [], []
                if key == first:
                    head.append(n or 0)
                else:
                    if key != last:
                        last, tail = key, []
                    tail.append(n or 0)
        if part is not None:
            found.append(summed(part, first, last, head, tail))
        kinds = [pa.int32(), pa.string(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 8, kinds)], names=names)

    names = ["part", "first", "last", "held", "starts", "tail", "open_sum", "open_number"]
    ddl = "part int, first string, last string, held array<bigint>, starts array<bigint>, tail array<bigint>, open_sum bigint, open_number bigint"
    thin = rows.select(*{c: 0 for c in ("_part", *by, *order, "_key", size)}).repartition("_part").sortWithinPartitions("_part", *by, *order)
    start, before = {}, None
    for r in thin.mapInArrow(run, ddl).orderBy("part").collect():  # one row a range
        goes_on = before is not None and before[0] == r.first
        if goes_on:
            start[r.part] = before
        if r.last != r.first:
            before = r.last, (r.open_sum, r.open_number)
        else:
            before = r.last, after(before[1] if goes_on else None, (r.held, r.starts, r.tail), limit)
    return start
