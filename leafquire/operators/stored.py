"""A stored keyword index: the terms of blocks of chunks as numbers, and search that reads them alone.

A row holds up to ``WIDTH`` chunks with ``TERMS`` terms in all: the different terms of their
texts, and the texts themselves as numbers of these, one after the other. Where a term stands
follows from that by one pass of counting, so places are not stored. A phrase is looked for in
a block only at the places of its rarest term, and not at all where that term is missing; its
other terms are then compared at their places beside it. Terms have at most two letters and are
kept as one number each, so no text is cut again, and nothing is compared as a string.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators import keyword
from leafquire.operators.best import in_blocks

#: Chunks of a block.
WIDTH = 64
#: Terms of a block, unless one chunk alone has more.
TERMS = 1 << 18

BLOCK = "chunk_id array<string>, doc_id array<string>, content_type array<string>, n array<int>, terms array<bigint>, times array<int>, cut binary"

#: How blocks are written. A reader holds a row group at once, unpacked; by default Parquet closes one after 128 MB, and looks only every 100 rows.
FILES = {"compression": "zstd", "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}

_LETTER = np.zeros(0x110000 + 1, bool)
for _run in re.finditer(P.WORD, "".join(map(chr, range(0x10000)))):
    _LETTER[_run.start() : _run.end()] = True


def code(term: str) -> int:
    """A term of one or two characters as a number; no two terms share one."""
    return ord(term[0]) << 21 | (ord(term[1]) if len(term) > 1 else 0)


def cut(text: bytes) -> np.ndarray:
    """The codes of the terms that ``X.grams`` makes of a text already in lower case."""
    at = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    inside = _LETTER[at]
    more = np.append(inside[1:], False)
    alone = inside & ~more
    alone[1:] &= ~inside[:-1]
    first = np.flatnonzero(inside & more | alone)
    return at[first] << 21 | np.where(more[first], np.append(at, 0)[first + 1], 0)


def _pack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The different codes in order, how often each occurs, and all of them as numbers of these."""
    known = pa.array(codes, pa.int64()).dictionary_encode()
    names = known.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(names)
    number = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.uint32)
    number[order] = np.arange(len(order))
    numbers = number[known.indices.to_numpy(zero_copy_only=False)]
    return names[order], np.bincount(numbers, minlength=len(order)), numbers.tobytes()


def unpack(terms: np.ndarray, times: np.ndarray, packed) -> dict:
    """What ``find_in`` reads of a block: its codes, and for each different term the places where it stands."""
    numbers = np.frombuffer(packed, np.uint16 if len(terms) <= 1 << 16 else np.uint32)
    return {"codes": terms[numbers], "terms": terms, "firsts": np.cumsum(times) - times, "places": np.argsort(numbers, kind="stable")}


def index_blocks(chunks: DataFrame, width: int = WIDTH, most: int = TERMS) -> DataFrame:
    """Blocks of ``chunks(chunk_id, doc_id, content_type, text)``. Texts are cut once; no shuffle.

    Empty and null texts are chunks without terms. Repeated chunks are indexed each.
    """
    rows = chunks.select("chunk_id", "doc_id", "content_type", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))

    def block(about, found):
        terms, times, packed = _pack(np.concatenate(found))
        whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        return pa.RecordBatch.from_arrays(
            [*(pa.ListArray.from_arrays(pa.array([0, about.num_rows], pa.int32()), about.column(c)) for c in ("chunk_id", "doc_id", "content_type")),
             whole([len(x) for x in found], pa.int32()), whole(terms, pa.int64()), whole(times, pa.int32()), pa.array([packed], pa.binary())],
            names=["chunk_id", "doc_id", "content_type", "n", "terms", "times", "cut"])

    def run(batches):
        for batch in batches:
            texts, found, held = batch.column("text"), [], 0
            for i in range(batch.num_rows):
                codes = cut(texts[i].as_py())
                if found and (len(found) == width or held + len(codes) > most):
                    yield block(batch.slice(i - len(found), len(found)), found)
                    found, held = [], 0
                found.append(codes)
                held += len(codes)
            if found:
                yield block(batch.slice(batch.num_rows - len(found)), found)

    return rows.mapInArrow(run, BLOCK)


def term_counts(blocks: DataFrame) -> DataFrame:
    """``(term, n)``: places of each term in all blocks; each block has added up its own."""
    counted = blocks.select(F.explode(F.arrays_zip("terms", "times")).alias("t"))
    return counted.groupBy(F.col("t.terms").alias("term")).agg(F.sum(F.col("t.times").cast("long")).alias("n"))


def corpus(blocks: DataFrame) -> tuple[int, float]:
    """Number of chunks and mean number of terms."""
    terms = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    row = blocks.agg(F.sum(F.size("n")).alias("n"), F.sum(terms).alias("terms")).first()
    return row["n"] or 0, (row["terms"] or 0) / (row["n"] or 1)


def write_index(chunks: DataFrame, path: str, width: int = WIDTH) -> None:
    """Store ``blocks`` and ``terms`` under ``path``; a run that fails leaves no ``terms``, so no half index is read."""
    index_blocks(chunks, width).write.mode("overwrite").options(**FILES).parquet(f"{path}/blocks")
    blocks = chunks.sparkSession.read.schema(BLOCK).parquet(f"{path}/blocks")
    term_counts(blocks).write.mode("overwrite").parquet(f"{path}/terms")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks"), spark.read.schema("term bigint, n bigint").parquet(f"{path}/terms")


def _plan(every: list[list[str]], counts: DataFrame):
    """The phrases as arrays: their codes, where each begins, and the offset of the rarest term of each."""
    flat = np.array([code(t) for p in every for t in p], np.int64)
    size = np.array([len(p) for p in every], np.int64)
    first = np.cumsum(size) - size
    known, of = np.unique(flat, return_inverse=True)
    wanted = counts.sparkSession.createDataFrame([(int(t),) for t in known], "term bigint")
    often = dict.fromkeys(known.tolist(), 0) | {r.term: r.n for r in counts.join(F.broadcast(wanted), "term").collect()}  # at most one row a term of the queries
    n = np.array([often[t] for t in known.tolist()], np.int64)[of]
    rarest = np.array([int(np.argmin(n[a : a + s])) for a, s in zip(first.tolist(), size.tolist())], np.int64)
    return flat, first, size, rarest


def _ranges(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``lo``, ``count`` of them, one range after the other."""
    return np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())


def find_in(block: dict, plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Chunk, phrase and number of times of what a block holds, and in how many cases a phrase's rarest term is missing."""
    flat, first, size, rarest = plan
    codes, terms, firsts, places, n = (block[c] for c in ("codes", "terms", "firsts", "places", "n"))
    nothing = (np.empty(0, np.int64),) * 3
    if not len(terms) or not len(size):
        return *nothing, len(size)
    rare = flat[first + rarest]
    at = np.minimum(np.searchsorted(terms, rare), len(terms) - 1)
    there = np.flatnonzero(terms[at] == rare)
    # One term beside the rarest is compared with it as one number, so few places of a frequent term become candidates.
    side = np.where(size == 1, 0, np.where(rarest + 1 < size, 1, -1))
    beside = flat[first + rarest + side]
    near = np.minimum(np.searchsorted(terms, beside), len(terms) - 1)
    able = there[terms[near[there]] == beside[there]]
    until = np.append(firsts[1:], len(codes)).astype(np.int64)
    numbers = np.empty(len(codes), np.int64)
    numbers[places] = np.repeat(np.arange(len(terms)), until - firsts)
    phrases, begins = [], []
    for s in (0, 1, -1):
        mine = able[side[able] == s]
        key = at[mine] * len(terms) + near[mine]
        mine, key = mine[(order := np.argsort(key, kind="stable"))], key[order]
        key, starts, count = np.unique(key, return_index=True, return_counts=True)
        held = np.unique(at[mine])
        place = places[_ranges(firsts[held].astype(np.int64), until[held] - firsts[held])].astype(np.int64)
        place = place[(place + s >= 0) & (place + s < len(codes))]
        found = numbers[place] * len(terms) + numbers[place + s]
        slot = np.minimum(np.searchsorted(key, found), max(len(key) - 1, 0))
        hit = np.flatnonzero(key[slot] == found) if len(key) else np.empty(0, np.int64)
        slot, place = slot[hit], place[hit]
        phrases.append(mine[_ranges(starts[slot], count[slot])])
        begins.append(np.repeat(place, count[slot]) - rarest[phrases[-1]])
    phrase, begin = np.concatenate(phrases), np.concatenate(begins)
    ends = np.cumsum(n)
    chunk = np.searchsorted(ends, begin + rarest[phrase], side="right")
    inside = (begin >= ends[chunk] - n[chunk]) & (begin + size[phrase] <= ends[chunk])
    phrase, begin, chunk = phrase[inside], begin[inside], chunk[inside]
    good, start, size_of, left = np.ones(len(phrase), bool), first[phrase], size[phrase], np.arange(len(phrase))
    for k in range(int(size.max())):
        left = left[size_of[left] > k]
        same = codes[begin[left] + k] == flat[start[left] + k]
        good[left[~same]] = False
        left = left[same]
    phrase, chunk = phrase[good], chunk[good]
    pairs, times = np.unique(chunk * len(size) + phrase, return_counts=True)
    return pairs // len(size), pairs % len(size), times, len(size) - len(there)


def matches_in(every: list[list[str]], blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """What ``keyword.matches_in`` finds, from stored blocks, with ``looked`` and ``skipped``.

    These count the phrases that were looked for in a block and those ruled out by their
    rarest term; they stand at the block's first chunk.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(_plan(every, counts))

    def run(batches):
        plan = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("chunk_id", "doc_id", "content_type", "n", "terms", "times")}
                n, terms, times = (row[c].to_numpy(zero_copy_only=False) for c in ("n", "terms", "times"))
                block = unpack(terms, times, batch.column("cut")[i].as_buffer()) | {"n": n}
                chunk, phrase, times, skipped = find_in(block, plan)
                total = len(row["chunk_id"])
                offsets = pa.array(np.searchsorted(chunk, np.arange(total + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (phrase, times)]
                once = lambda x: pa.array([x] + [0] * (total - 1), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [row["chunk_id"], row["doc_id"], row["content_type"], row["n"], *lists, once(len(plan[2]) - skipped), once(skipped)],
                    names=["chunk_id", "doc_id", "content_type", "n", "ids", "f", "looked", "skipped"])

    return blocks.mapInArrow(run, "chunk_id string, doc_id string, content_type string, n int, ids array<int>, f array<int>, looked long, skipped long")


def search(queries: DataFrame, blocks: DataFrame, counts: DataFrame, k: int = P.POOL) -> DataFrame:
    """``keyword.keyword_search`` over a stored index: the same rows, ranks and scores.

    How many chunks hold a phrase is a part of its score, so every place of its rarest
    term is looked at, once for each block of queries. Texts are not read.
    """
    asked = queries.select("query_id", X.phrases(F.col("query")).alias("phrases"), "doc_id", "content_type").where(F.size("phrases") > 0)
    statistics = corpus(blocks)
    found = blocks.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double")
    for block in in_blocks(asked, keyword.BROADCAST_TERMS, lambda r: sum(map(len, r.phrases))):
        found = found.unionByName(keyword.best_in(block, lambda every: matches_in(every, blocks, counts), k, statistics, blocks.sparkSession))
    return keyword.top(found, k)
