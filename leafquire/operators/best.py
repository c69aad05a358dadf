"""The best rows of many queries, kept while a task reads its part of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Best:
    """For each of ``n`` queries the ``k`` least values, ties by name."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.values = [np.empty(0)] * n
        self.names = [np.empty(0, "U1")] * n

    def limit(self, i: int) -> float:
        """Larger values cannot count for query ``i`` any more."""
        v = self.values[i]
        return v[-1] if len(v) == self.k else np.inf

    def add(self, i: int, values: np.ndarray, names: np.ndarray) -> None:
        if len(values) > self.k:
            near = values <= np.partition(values, self.k - 1)[self.k - 1]
            values, names = values[near], names[near]
        values, names = np.concatenate((self.values[i], values)), np.concatenate((self.names[i], names))
        order = np.lexsort((names, values))[: self.k]
        self.values[i], self.names[i] = values[order], names[order]

    def rows(self, ids: list[str], value: str) -> pa.RecordBatch:
        counts = [len(v) for v in self.values]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(ids, object), counts), pa.string()), pa.array(np.concatenate([n.astype(object) for n in self.names]), pa.string()), pa.array(np.concatenate(self.values))],
            names=["query_id", "chunk_id", value],
        )


def strings(column: pa.Array) -> np.ndarray:
    """A column as a numpy array of strings, null as the empty one."""
    return np.array([x or "" for x in column.to_pylist()], dtype=np.str_)


def allowed(batch: pa.RecordBatch, limits: list[tuple[str | None, str | None]]) -> list[np.ndarray | None]:
    """For each query the rows that pass its ``doc_id`` and ``content_type``; None where all pass."""
    has = [np.array(batch.column(c).to_pylist(), object) for c in ("doc_id", "content_type")]
    known: dict = {(None, None): None}
    for limit in limits:
        if limit not in known:
            known[limit] = np.logical_and.reduce([h == w for h, w in zip(has, limit) if w is not None])
    return [known[limit] for limit in limits]


def in_blocks(rows: DataFrame, most: int, cost=lambda r: 1) -> Iterator[list]:
    """The rows in blocks of at most about ``most`` in cost: only one block is held at a time."""
    block, total = [], 0
    for row in rows.toLocalIterator():
        block.append(row)
        total += cost(row)
        if total >= most:
            yield block
            block, total = [], 0
    if block:
        yield block
