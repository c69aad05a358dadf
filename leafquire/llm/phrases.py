"""Collocations by dynamic itemset counting.

The documents are dealt into shards, which are scanned in a cycle. A scan counts phrases
of several lengths at once: words from the first scan on, and a longer phrase from the
scan after the one in which both phrases that it consists of (all but its last word, all
but its first) are known to occur often enough, until it has met every shard once. As no
phrase is more frequent than its parts, every frequent phrase gets its full cycle.

Most phrases never pass, so those that others may be built on are first counted by a
64-bit hash, and those that pass then by name, again for a cycle. The longest are counted
by name from the start. Tasks know what has passed by bit maps of a fixed size. Hashes
and bit maps may let others through, which only adds rows: counts by name are kept for
each shard, so that a phrase that meets a shard twice counts once, and a phrase below the
threshold stays there whatever of it was counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leafquire.llm.shared import discard, materialize, table, work_dir

UNKNOWN = "und"
LONGEST = 3
THRESHOLD = 10
SHARDS = 2
TOP = 2000
#: Bits of a map of passed phrases (8 MB), whatever the input. Fuller maps let more rows through.
BITS = 1 << 26
#: Bytes of text that a task counts together.
BLOCK = 3_000_000

_END = b"\xff"  # not a byte of UTF-8
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 255 if chr(c) in ".,;:!?" or 10 <= c <= 13 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _joined(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and that of its last word."""
    x = (first ^ (first >> np.uint64(29))) * _ODD + word
    return (x ^ (x >> np.uint64(32))) * _ODD


class Marks:
    """A set of hashes as a bit map: two bits for each."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.map = np.zeros(bits // 64, np.uint64)

    def _places(self, hashes: np.ndarray):
        for x in (hashes, hashes >> np.uint64(32)):
            x = x & np.uint64(self.bits - 1)
            yield (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        for at, bit in self._places(hashes):
            np.bitwise_or.at(self.map, at, bit)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        (a, x), (b, y) = self._places(hashes)
        return (self.map[a] & x != 0) & (self.map[b] & y != 0)

    @staticmethod
    def union(sets: list[Marks], bits: int) -> Marks:
        out = Marks(bits)
        for one in sets:
            out.map |= one.map
        return out


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _count(data: bytes, seed: int, scan: int, shards: int, longest: int, passed: dict):
    """What one scan counts in one language's texts: ``(words in it, names or None, hashes or None, counts)``.

    ``passed[n]`` has the phrases of n words that passed before this scan, and those of
    them that passed within the last cycle.
    """
    tokens = data.translate(_FOLD).replace(_END, b" " + _END + b" ").split()
    if not tokens:
        return
    column = pa.array(tokens, pa.binary()).dictionary_encode()
    words, ids = column.dictionary, column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    del tokens
    names = words.to_pylist()
    width = len(names)
    valid = ids != (names.index(_END) if _END in names else -1)
    counts = np.bincount(ids[valid], minlength=width)
    hashes = of_words = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), np.uint64, width)
    if scan < shards:
        yield 0, pa.array([b""]), None, counts.sum(keepdims=True)
        some = np.flatnonzero(counts)
        yield 1, None, hashes[some], counts[some]
    phrases, group = words, ids  # group: which phrase of n words begins here, if valid
    for n in range(1, longest):
        if n not in passed:
            return
        every, recent = passed[n]
        ok, late = every.has(hashes), recent.has(hashes)
        some = np.flatnonzero(late & (counts > 0))
        yield n, phrases.take(pa.array(some)), None, counts[some]
        here = valid & ok[group]
        begin = np.flatnonzero(here[:-1] & here[1:])
        if not len(begin):
            return
        key, of = np.unique(group[begin] * width + ids[begin + n], return_inverse=True)
        first, last = key // width, key % width
        counts = np.bincount(of)
        news = np.zeros(len(key), bool)  # one of its parts passed within the last cycle
        news[of[late[group[begin]] | late[group[begin + 1]]]] = True
        some = np.flatnonzero(news)
        if n + 1 == longest:
            yield longest, pc.binary_join_element_wise(phrases.take(pa.array(first[some])), words.take(pa.array(last[some])), b" "), None, counts[some]
            return
        hashes = _joined(hashes[first], of_words[last])
        if scan < (n + 1) * shards:
            yield n + 1, None, hashes[some], counts[some]
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(first)), words.take(pa.array(last)), b" ")
        valid, group = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
        valid[begin], group[begin] = True, of


COUNTED = "lang string, n int, phrase string, hash long, now long"


def _scan(docs: DataFrame, scan: int, shards: int, longest: int, passed, block: int) -> DataFrame:
    """What the tasks of one scan count, not yet added up: named rows, and hashed ones without language and phrase."""

    def run(batches):
        open_blocks: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang):
            data = _END.join(open_blocks.pop(lang))
            del sizes[lang]
            for n, phrases, hashes, counts in _count(data, _seed(lang), scan, shards, longest, passed.value):
                for at in range(0, len(counts), 100_000):
                    size = min(100_000, len(counts) - at)
                    named = phrases is not None
                    columns = [
                        pa.repeat(pa.scalar(lang), size) if named else pa.nulls(size, pa.string()), pa.repeat(pa.scalar(n, pa.int32()), size),
                        phrases.slice(at, size).cast(pa.string()) if named else pa.nulls(size, pa.string()),
                        pa.nulls(size, pa.int64()) if named else pa.array(hashes[at : at + size].view(np.int64)), pa.array(counts[at : at + size], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "n", "phrase", "hash", "now"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    open_blocks.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text)
                    if sizes[lang] >= block:
                        yield from flush(lang)
                        pa.default_memory_pool().release_unused()
        for lang in list(open_blocks):
            yield from flush(lang)

    return docs.select("lang", "text").mapInArrow(run, COUNTED)


def _marks(fresh: DataFrame, levels: int, bits: int) -> dict[int, Marks]:
    """A bit map of the hashes of each length; what reaches the driver has a bounded size."""

    def run(batches):
        maps: dict[int, Marks] = {}
        for batch in batches:
            n, hashes = batch.column("n").to_numpy(), batch.column("hash").to_numpy().view(np.uint64)
            for k in np.unique(n).tolist():
                maps.setdefault(k, Marks(bits)).add(hashes[n == k])
        for n, marks in maps.items():
            at = np.flatnonzero(marks.map)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(n, pa.int32()), len(at)), pa.array(at), pa.array(marks.map[at].view(np.int64))], names=["n", "at", "bits"])

    rows = fresh.select("n", "hash").mapInArrow(run, "n int, at long, bits long").groupBy("n", "at").agg(F.bit_or("bits").alias("bits"))
    out = {n: Marks(bits) for n in range(1, levels + 1)}
    for part in rows.toArrow().to_batches():
        n, at, value = (part.column(c).to_numpy() for c in ("n", "at", "bits"))
        for k in np.unique(n):
            mine = n == k
            out[int(k)].map[at[mine]] = value[mine].view(np.uint64)
    return out


def count_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, threshold: int = THRESHOLD,
    shards: int = SHARDS, bits: int = BITS, block: int = BLOCK,
) -> DataFrame:
    """``lang, n, phrase, f``: the phrases of 1 to ``longest`` words that occur ``threshold`` times.

    A row with ``n`` 0 and an empty phrase counts all words of a language. Texts are
    lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words
    at spaces and tabs; a phrase lies within a piece. A null text is empty, a null
    language is ``und``. Repeated rows count as often as they stand there; an empty
    table gives no rows. Other columns are not read.

    Each scan is written to the shared folder, so a lost executor costs a part of one
    scan. Tasks add up what they count before it is shuffled by phrase or hash, which
    no frequent word or language makes hot.
    """
    spark = docs.sparkSession
    kinds = T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()), T.StructField("shard", T.IntegerType())])
    home = work_dir(spark)
    dealt = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    dealt.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int")).write.partitionBy("shard").parquet(home)
    dealt = spark.read.schema(kinds).parquet(home)

    n = F.col("n")
    hashed, news, named, spent = None, [], [], [dealt]
    for scan in range(longest * shards):
        since = max(0, scan - shards)
        # A cycle in which nothing passed ends it: no phrase is still active.
        if scan >= shards and not any(marks.map.any() for made in news[since:] for marks in made.values()):
            break
        passed = {k: (Marks.union([x[k] for x in news], bits), Marks.union([x[k] for x in news[since:]], bits)) for k in range(1, min(longest, scan + 1))}
        sent = spark.sparkContext.broadcast(passed)
        rows = _scan(dealt.where(F.col("shard") == scan % shards), scan, shards, longest, sent, block).withColumn("passed", F.lit(None).cast("int"))
        live = n > scan // shards  # shorter phrases have had their cycle
        if hashed is not None:
            rows = rows.unionByName(hashed.where(live).select(F.lit(None).cast("string").alias("lang"), "n", F.lit(None).cast("string").alias("phrase"), "hash", F.col("f").alias("now"), "passed"))
        summed = rows.groupBy("lang", "n", "phrase", "hash").agg(F.sum("now").alias("f"), F.min("passed").alias("passed"))
        by_hash = F.col("hash").isNotNull()
        summed = summed.withColumn("passed", F.coalesce("passed", F.when(by_hash & (F.col("f") >= threshold), scan))).withColumn("named", F.when(by_hash, 0).otherwise(1))
        path = work_dir(spark)
        summed.write.partitionBy("named").parquet(path)
        now = spark.read.schema(summed.schema).parquet(path)
        hashed = now.where("named = 0")
        named.append(now.where("named = 1").select("lang", "n", "phrase", F.lit(scan % shards).alias("shard"), "f"))
        if scan < (longest - 1) * shards:
            news.append(_marks(hashed.where(F.col("passed") == scan), longest - 1, bits))
        else:
            news.append({k: Marks(bits) for k in range(1, longest)})
        sent.unpersist()
        spent.append(now)
    rows = named[0]
    for more in named[1:]:
        rows = rows.unionByName(more)
    per_shard = [F.max(F.when(F.col("shard") == s, F.col("f"))) for s in range(shards)]
    totals = rows.groupBy("lang", "n", "phrase").agg(sum((F.coalesce(c, F.lit(0)) for c in per_shard), F.lit(0)).cast("long").alias("f"))
    out = materialize(totals.where((n == 0) | (F.col("f") >= threshold)))
    for old in spent:
        discard(old)
    return out


def _part(words, first, length):
    return F.array_join(F.slice(words, first, length), " ")


def collocations(counts: DataFrame, threshold: int = THRESHOLD, top: int | None = TOP, cover: int = 50) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    ``counts`` is what ``count_phrases`` returns. A phrase that occurs ``a`` times, cut
    after its first k words into parts that occur ``l`` and ``r`` times, scores
    floor(10**6 a a / (l r)), in whole numbers of 38 digits (``a`` below 10**16); its lowest cut counts, of ties
    that with the smallest k. A phrase inside a longer one that occurs at least ``cover``
    percent as often is dropped. Ties of the score are ordered by ``a``, then by the
    phrase's bytes. ``n`` counts the language's words. ``top`` None keeps all ranks.
    """
    totals = counts.where("n = 0").select("lang", F.col("f").alias("total"))
    often = counts.where((F.col("n") > 0) & (F.col("f") >= threshold))
    phrases = often.where("n > 1").withColumn("words", F.split("phrase", " "))
    w, n = F.col("words"), F.col("n")
    cuts = phrases.select("lang", "n", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = cuts.select("lang", "n", "phrase", "a", "k", _part(w, F.lit(1), F.col("k")).alias("first"), _part(w, F.col("k") + 1, n - F.col("k")).alias("rest"))
    for name, part in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(often.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(name)), (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_phrase"))).drop("_lang", "_phrase")
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000000 * {wide('a')} AS DECIMAL(22, 0)) * CAST(a AS DECIMAL(16, 0))) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: _part(w, i, m))))
    longer = phrases.where("n > 2").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True)))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of 2 to 3 words; null texts are empty, a null language is ``und``."""
    return collocations(count_phrases(table(spark, sf_dir, "documents")))
