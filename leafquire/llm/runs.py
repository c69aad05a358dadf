"""Periodic runs of words by internal pattern matching.

The words of a block of texts are one sequence with an end mark behind each text. Its
suffix array comes from prefix doubling, whose rounds also name all stretches of 2**k
words. Dyadic blocks (2**k words at multiples of 2**k) ask a wavelet tree over the suffix
array for their next occurrence, again and again, as far as four times their length.
Occurrences that overlap by half or more form progressions, which are stepped over as a
whole. What distances remain are candidate periods; the names extend each to both sides
until the words differ, which also confirms it.

Any run of period q and at least max(12, 2 q) words holds, before its last q words, a
block of 2**k > (q + 1) / 4 words whose copy q words on lies in the run too, so that
block meets its period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafquire.llm.shared import let, table, words

#: A run has this many words at least, and its period twice.
LEAST = 12
#: Words that are worked on together; a longer text is a block of its own.
BLOCK = 200_000

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


class Suffixes:
    """Suffix array of a sequence whose texts end in marks that occur once.

    ``names[k][i]`` is the slot of the first suffix that begins with the same 2**k words
    as suffix ``i``; ``shared[k]`` are the places whose 2**k words occur elsewhere too.
    """

    def __init__(self, sequence: np.ndarray):
        self.order = np.argsort(sequence)
        self.names: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []
        key, slots, rank = sequence[self.order], np.arange(len(sequence)), np.empty(len(sequence), np.int32)
        at, width = self.order, 1
        while True:
            new = np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1]))
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            self.names.append(rank)
            alone = new & np.concatenate((new[1:], np.ones(min(len(key), 1), bool)))
            slots, at = slots[~alone], at[~alone]
            self.shared.append(at)
            if len(self.shared) == 2:
                self.slots = slots
            if not len(slots):
                break
            key = rank[at].astype(np.int64) * (len(rank) + 1) + rank[at + width]
            by = np.argsort(key)
            at, key = at[by], key[by]
            self.order[slots] = at
            width *= 2
        if len(self.shared) < 2:
            self.slots = slots

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are the same from ``a`` and ``b`` on."""
        a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            step = (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
            a, b, n = a + step, b + step, n + step
        return n

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are the same right before ``a`` and ``b``, where a < b."""
        a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 2, -1, -1):
            width = 1 << k
            inside = a >= width
            same = inside & (self.names[k][np.where(inside, a - width, 0)] == self.names[k][np.where(inside, b - width, 1)])
            step = same.astype(np.int64) << k
            a, b, n = a - step, b - step, n + step
        return n


class WaveletTree:
    """Range successor over an array of distinct numbers, level by level from the highest bit."""

    def __init__(self, values: np.ndarray, top: int):
        self.none = top
        self.levels = []
        now = values
        for shift in range(int(top).bit_length() - 1, -1, -1):
            ones = ((now >> shift) & 1).astype(bool)
            zeros = np.concatenate(([0], np.cumsum(~ones))).astype(np.int32)
            self.levels.append((shift, zeros))
            now = np.concatenate((now[~ones], now[ones]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of the slots lo to hi - 1 are less than x."""
        n = np.zeros(len(lo), np.int64)
        for shift, zeros in self.levels:
            lo0, hi0 = zeros[lo], zeros[hi]
            one = ((x >> shift) & 1).astype(bool)
            n += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, zeros[-1] + lo - lo0, lo0), np.where(one, zeros[-1] + hi - hi0, hi0)
        return n

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value of at least x in the slots lo to hi - 1; ``none`` if there is none."""
        left = self.below(lo, hi, x)
        found = left < hi - lo
        out = np.full(len(lo), self.none, np.int64)
        lo, hi, left, value = lo[found], hi[found], left[found], np.zeros(int(found.sum()), np.int64)
        for shift, zeros in self.levels:
            lo0, hi0 = zeros[lo], zeros[hi]
            one = left >= hi0 - lo0
            left = np.where(one, left - (hi0 - lo0), left)
            value |= one.astype(np.int64) << shift
            lo, hi = np.where(one, zeros[-1] + lo - lo0, lo0), np.where(one, zeros[-1] + hi - hi0, hi0)
        out[found] = value
        return out


def _candidates(suffixes: Suffixes, tree: WaveletTree, slot_of: np.ndarray, k: int, s: np.ndarray):
    """Distances from the blocks of 2**k words at ``s`` to their next occurrences: ``(places, distances)``."""
    width, half = 1 << k, 1 << (k - 1)
    size = np.bincount(suffixes.names[k][suffixes.shared[k]], minlength=len(slot_of))
    head = suffixes.names[k][s]
    lo, hi, last = slot_of[head], slot_of[head] + size[head], s + 4 * width - 2
    here = s
    after = tree.successor(lo, hi, here + 1)
    while True:
        near = (after <= last) & (after < tree.none)
        s, lo, hi, last, here, after = (x[near] for x in (s, lo, hi, last, here, after))
        if not len(s):
            return
        yield s, after - s
        own = (here == s) & (after - here <= half)
        # Where a progression begins: at the block itself, or at the occurrence just met.
        begin = np.where(own, here, after)
        follow = after.copy()
        follow[~own] = tree.successor(lo[~own], hi[~own], after[~own] + 1)
        gap = follow - begin
        chain = np.flatnonzero((follow < tree.none) & (gap <= half))
        end = begin.copy()
        if len(chain):
            period, first = gap[chain], begin[chain]
            stop = first + period + suffixes.ahead(first, first + period)
            end[chain] = first + (stop - width - first) // period * period
            # The block's own progression has one period; another's members may each be the period's place.
            more = np.where(own[chain], 0, (np.minimum(end[chain], last[chain]) - first) // period)
            of = np.repeat(chain, more)
            if len(of):
                count = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more) + 1
                yield s[of], begin[of] + count * gap[of] - s[of]
            follow[chain] = tree.successor(lo[chain], hi[chain], end[chain] + 1)
        here, after = end, follow


def runs_of(sequence: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and least period of all runs, ordered by start, then period.

    ``sequence`` numbers words so that no two texts share a number; each text begins at
    one of ``starts`` and ends in a mark that occurs once.
    """
    suffixes = Suffixes(sequence)
    slot_of = np.zeros(len(sequence), np.int64)
    slot_of[suffixes.slots] = np.arange(len(suffixes.slots))
    tree = WaveletTree(suffixes.order[suffixes.slots], len(sequence))
    place = np.arange(len(sequence)) - np.repeat(starts, np.diff(np.append(starts, len(sequence))))
    found = []
    for k in range(1, len(suffixes.names) - 1):
        shared = suffixes.shared[k]
        found += _candidates(suffixes, tree, slot_of, k, shared[place[shared] % (1 << k) == 0])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, q = (np.concatenate(x) for x in zip(*found))
    back = suffixes.behind(s, s + q)
    start, length = s - back, back + q + suffixes.ahead(s, s + q)
    keep = length >= np.maximum(least, 2 * q)
    start, length, q = start[keep], length[keep], q[keep]
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    # A multiple of a period gives the same stretch; the least period stands first.
    first = np.ones(len(by), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[first], length[first], q[first]
    by = np.lexsort((q, start))
    return start[by], length[by], q[by]


def _block(texts: list[list[bytes]], least: int):
    """Runs and collapsed text of each of some texts, given as words."""
    counts = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(counts + 1)[:-1]))
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.arange(len(texts), dtype=np.int64) * (len(flat.dictionary) + 1)
    sequence = np.zeros(int(counts.sum()) + len(texts), np.int64)
    mark = starts + counts
    filled = np.ones(len(sequence), bool)
    filled[mark] = False
    sequence[filled] = np.repeat(own, counts) + ids + 1
    sequence[mark] = own
    start, length, period = runs_of(sequence, starts, least)
    depth = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    dropped = np.cumsum(depth)[:-1] > 0
    bounds = np.searchsorted(start, np.append(starts, len(sequence)))
    collapsed = []
    for i, text in enumerate(texts):
        if bounds[i + 1] > bounds[i]:
            gone = dropped[starts[i] : mark[i]].tolist()
            text = [w for w, g in zip(text, gone) if not g]
        collapsed.append(b" ".join(text))
    start = start - np.repeat(starts, np.diff(bounds))
    return bounds, start, length, period, collapsed


def _blocks(texts, block: int):
    """Lists of texts, as words, of about ``block`` words together."""
    now, n = [], 0
    for text in texts:
        now.append((text or b"").split())  # splits at space and the controls 9 to 13, as the contract does
        n += len(now[-1]) + 1
        if n >= block:
            yield now
            now, n = [], 0
    if now:
        yield now


def find_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """Add ``runs`` (start, length, period of each, by start, then period) and ``collapsed``.

    A run is a stretch of consecutive words whose least period is q, of at least
    ``max(least, 2 q)`` words, that no neighbouring word extends keeping the period.
    ``collapsed`` holds the words, joined by one space, that no run contains after its
    first q words. Null and empty texts have no runs and collapse to the empty text.
    Texts are independent, so this is a map without a shuffle: repeated rows get equal
    results and an empty table stays empty. Memory holds ``block`` words, or the longest
    text, at about 4 bytes a word for each doubling of its longest repeat. Other columns
    stay; columns named like the new ones are replaced, so ``collapsed`` may be ``text``.
    """
    rest = [c for c in df.columns if c not in (runs, collapsed)]
    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField(runs, T.ArrayType(RUN, False), False), T.StructField(collapsed, T.StringType(), False)])

    def run(batches):
        for batch in batches:
            at = 0
            for texts in _blocks(batch.column(text).cast(pa.binary()).to_pylist(), block):
                bounds, start, length, period, short = _block(texts, least)
                fields = [pa.field(f, pa.int64(), False) for f in RUN.names]
                values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=fields)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, type=pa.list_(pa.field("element", values.type, False)))
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*map(part.column, rest), lists, pa.array(short, pa.binary()).cast(pa.string())], names=[*rest, runs, collapsed])

    return df.select(*dict.fromkeys([*rest, text])).mapInArrow(run, schema)


def planted(text: Column, key: Column) -> Column:
    """The text with a repetition planted in one of ten documents, as the query's contract says.

    With h the CRC-32 of the decimal key and g = h div 10: if h is a multiple of ten, the
    words from a = g mod n on repeat their first 1 + (n - a) div (3 + g mod 8). A null key
    leaves the text as it is.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        plan = F.struct(a.cast("int").alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p"))
        pick = lambda i, x: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])
        whole = let(plan, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, pick(i, x))), " "))
        return F.when(n > 0, whole).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document; null texts and texts without runs have ``n_runs`` 0 and four nulls."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    out = find_runs(docs, collapsed="text").withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
