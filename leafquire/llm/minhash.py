"""Near-duplicate documents by HyperMinHash registers, bands and exact confirmation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafquire.llm.shared import components, discard, materialize, table, whole_groups

SHINGLE = 5
PERCENT = 80
#: 32 bands of 5 registers: a pair at a similarity of 0.8 shares no band once in 300,000 times.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: A register keeps the leading zeros of the least hash and this many bits behind the first one.
MANTISSA = 10
#: Pairs whose corrected estimate lies this far below the threshold are not confirmed:
#: five standard deviations of an estimate from 160 registers at 0.8.
MARGIN = 0.16
#: Members of an open bucket are compared in tiles of about this many, with about this many shingles in all.
TILE, TILE_SHINGLES = 1024, 1 << 21
#: Words of 64 bits in a map of wanted rows: at most so many rows, about 6 MB, go to all tasks.
MARK_WORDS = 1 << 18
#: Hashes that are combined at once; it bounds memory, not the sets.
BLOCK = 1 << 15

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
PLACES = np.uint64(0x9E3779B97F4A7C15)
FACTORS = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a published finalizer: two shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, PLACES, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(PLACES), -1, 2**64))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of UTF-8 bytes, in order, all bytes at once.

    A word's hash is the sum of its bytes' codes times powers of an odd constant,
    taken from running sums and shifted to the word's start; A-Z count as a-z.
    """
    if not len(data):
        return np.empty(0, np.uint64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edges[::2], edges[1::2]
    codes = BYTE_CODES.copy()
    codes[65:91] = codes[97:123]
    out, block = [], 1 << 20
    first = 0
    while first < len(starts):  # whole words in blocks of about a million bytes
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + block)))
        lo, hi = int(starts[first]), int(ends[last - 1])
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes[data[lo:hi]] * _powers(hi - lo), dtype=np.uint64)))
        s, e = starts[first:last] - lo, ends[first:last] - lo
        back = np.full(hi - lo + 1, _INVERSE, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        out.append(mix((running[e] - running[s]) * back[s] + (e - s).astype(np.uint64)))
        first = last
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; fewer words are one shingle."""
    h = word_hashes(np.frombuffer(text, np.uint8))
    n = len(h)
    if not n:
        return h
    width = min(n, size)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * PLACES + h[i : n - width + 1 + i])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading-zero counts and mantissa bits of the least hash in each of the register's orders."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(low), BLOCK // 8):
        np.minimum(least, (low[i : i + BLOCK // 8, None] * FACTORS + OFFSETS).min(0), out=least)
    wide = np.maximum(least, 1).astype(np.float64)
    zeros = 31 - np.floor(np.log2(wide)).astype(np.int64)
    behind = (least.astype(np.uint64) << (zeros + 1).astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return (zeros.astype(np.uint16) << MANTISSA) | behind.astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    rows = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * PLACES + rows[:, i])
    return key.view(np.int64)


@lru_cache(1)
def _chances() -> np.ndarray:
    """Chance that registers of disjoint sets agree, by the sets' sizes in half powers of two."""
    steps = np.arange(2**MANTISSA) / 2**MANTISSA
    lo = np.concatenate([(1 + steps) * 2.0 ** -(z + 1) for z in range(32)])
    wide = np.repeat([2.0 ** -(z + 1 + MANTISSA) for z in range(32)], len(steps))
    sizes = 2.0 ** (np.arange(64) / 2)
    cells = (1 - lo) ** sizes[:, None] - np.maximum(0, 1 - lo - wide) ** sizes[:, None]
    return cells @ cells.T


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, corrected for those that agree by chance."""
    size = lambda x: np.minimum(63, np.round(2 * np.log2(np.maximum(x, 1)))).astype(np.int64)
    chance = _chances()[size(n), size(m)]
    return ((a == b).mean(-1) - chance) / (1 - chance)


def text_print(text) -> Column:
    """A fingerprint of a whole text (a column): 128 bits; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def marked(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Add ``_marked``: true where ``wanted`` holds the row's value of ``name``, false for most other rows.

    A bit map of a fixed size goes to all tasks, so unwanted rows can stay out of a shuffle
    whatever the size of ``wanted``; rows marked in error are for an exact join to sort out.
    ``name`` must not be null.
    """
    place = F.pmod(F.shiftright("_hash", 6), F.lit(MARK_WORDS))
    bit = "CAST(_hash & 63 AS INT)"
    marks = wanted.select(F.xxhash64(name).alias("_hash")).groupBy(place.alias("_word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("_bits"))
    rows = rows.withColumn("_hash", F.xxhash64(name)).withColumn("_word", place).join(F.broadcast(marks), "_word", "left")
    return rows.withColumn("_marked", F.expr(f"coalesce(shiftrightunsigned(_bits, {bit}) & 1 = 1, false)")).drop("_hash", "_word", "_bits")


def sketch(df: DataFrame, key: str, text: str, size: int = SHINGLE) -> DataFrame:
    """``(key, print, n, set_id, regs, bands)`` of each row: a map over whole texts.

    ``n`` is the number of distinct shingles, ``set_id`` a 128-bit fingerprint of the
    set (null for none), ``regs`` the registers and ``bands`` the band keys.
    """
    schema = T.StructType([
        T.StructField("key", df.schema[key].dataType), T.StructField("print", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()),
        T.StructField("regs", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        for batch in batches:
            n, ids, regs, bands = [], [], [], []
            for value in batch.column(2):
                s = shingles(value.as_buffer() if value.is_valid else b"", size)
                n.append(len(s))
                if not len(s):
                    ids.append(None), regs.append(None), bands.append(None)
                    continue
                r = registers(s)
                ids.append(s.sum(dtype=np.uint64).tobytes() + mix(s).sum(dtype=np.uint64).tobytes() + len(s).to_bytes(8, "little"))
                regs.append(r.tobytes())
                bands.append(band_keys(r))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["key", "print", "n", "set_id", "regs", "bands"],
            )

    return df.select(F.col(key), text_print(F.col(text)).alias("print"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose corrected estimate does not rule out the threshold, with ``est``."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    # Most classes are in no pair: a bit map keeps their registers out of the shuffles.
    classes = marked(classes, "node", pairs.select(F.explode(F.array("a", "b")).alias("node"))).where("_marked")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    schema = T.StructType([*pairs.select("a", "b").schema.fields, T.StructField("est", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cols = {c: batch.column(c) for c in ("ra", "rb")}
                ra, rb = (np.frombuffer(b"".join(cols[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                est = estimate(ra, rb, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], names=["a", "b", "est"])

    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, schema).where(F.col("est") >= percent / 100 - MARGIN)


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` with 100 * intersection >= percent * union, on full sets.

    Only the texts named in pairs are read again; each becomes its sorted set of
    64-bit shingle hashes, and a pair is decided where its two sets meet.
    """
    sets = _sets(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), reps, key, text, size)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def check(batches):
        for batch in batches:
            good = [
                _together(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("sa"), batch.column("sb"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = materialize(joined.mapInArrow(check, "a long, b long"))
    discard(sets)
    return links


def _together(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


GROUP = ["bucket", "i", "j"]


def _tiled(members: DataFrame) -> DataFrame:
    """The rows of each tile (i, j) of a bucket: the strays of part i beside the members of part j.

    There are as many parts of strays as the strays need, and of members as those need,
    so a bucket with few strays sends its members about once.
    """
    parts = lambda n, shingles: F.greatest(F.lit(1), F.ceil(F.col(n) / TILE), F.ceil(F.col(shingles) / TILE_SHINGLES)).cast("int")
    rows, columns = parts("strays", "stray_shingles"), parts("size", "shingles")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    slim = ["bucket", "band", "node", "comp", "n", "regs"]
    strays = members.where(~F.col("main")).select(*slim, F.lit(0).alias("side"), part(rows).alias("i"), every(columns).alias("j"))
    others = members.select(*slim, F.lit(1).alias("side"), part(columns).alias("j"), every(rows).alias("i")).select(*slim, "side", "i", "j")
    return strays.unionByName(others)


def _possible(members: DataFrame, percent: int) -> DataFrame:
    """Which members of open buckets must meet: ``(bucket, i, j, node, comp, partners)``.

    ``members(bucket, band, node, comp, n, regs, main, size, shingles, strays, stray_shingles)``: rows with ``main``
    belong to the bucket's largest component. Every other member is held against every member,
    tile by tile, by registers alone; a pair counts in the first bucket that it shares.
    A row names the partners that the estimate allows a node, so there is one row for
    each node in a tile, however many pairs there are; partners come as rows of their own.
    """
    fields = "bucket long, i int, j int, node long, comp long, partners array<long>"
    names = ["bucket", "i", "j", "node", "comp", "partners"]

    def run(batches):
        for rows, starts in whole_groups(batches, GROUP):
            out = {name: [] for name in names}
            col = {c: rows.column(c).to_numpy() for c in ("bucket", "i", "j", "band", "n", "comp", "node", "side")}
            regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                side, n, comp, node = (col[c][start:end] for c in ("side", "n", "comp", "node"))
                r, band = regs[start:end], int(col["band"][start])
                right = np.flatnonzero(side == 1)
                needed: dict[int, list[int]] = {}
                for x in np.flatnonzero(side == 0).tolist():
                    at = right[(comp[right] != comp[x]) & (np.minimum(n[x], n[right]) * 100 >= np.maximum(n[x], n[right]) * percent)]
                    if not len(at):
                        continue
                    same = r[at] == r[x]
                    first = same.reshape(len(at), BANDS, ROWS).all(2).argmax(1)
                    at = at[(first == band) & (estimate(r[at], r[x], n[at], n[x]) >= percent / 100 - MARGIN)]
                    if len(at):
                        needed[x] = node[at].tolist()
                        for y in at.tolist():
                            needed.setdefault(y, [])
                seen: dict = {}
                for x, partners in needed.items():  # a stray stands on both sides: one row for it
                    seen.setdefault(node[x], [x, []])[1].extend(partners)
                for name, (x, partners) in seen.items():
                    for key, value in zip(out, (col["bucket"][start], col["i"][start], col["j"][start], name, comp[x], partners)):
                        out[key].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["bucket"], pa.int64()), pa.array(out["i"], pa.int32()), pa.array(out["j"], pa.int32()), pa.array(out["node"], pa.int64()),
                 pa.array(out["comp"], pa.int64()), pa.array(out["partners"], pa.list_(pa.int64()))], names=list(out))

    tiled = _tiled(members).repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "node")
    return tiled.mapInArrow(run, fields)


def _sets(docs: DataFrame, named: DataFrame, reps: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``(node, set)``: the full sorted shingle sets of the classes in ``named(node)``, from the text that stands for each.

    Rows of one key may differ, so texts are found by key and fingerprint.
    """

    def make(batches):
        for batch in batches:
            out = [shingles(t.as_buffer() if t.is_valid else b"", size).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "set"])

    # Written first: its true size decides whether the texts must be shuffled to it.
    wanted = materialize(reps.select("node", F.col("key").alias("_key"), F.col("print").alias("_print")).join(named, "node", "left_semi"))
    texts = docs.select(F.col(key).alias("_key"), text_print(F.col(text)).alias("_print"), F.col(text).cast("binary").alias("text"))
    # Rows that repeat a key and a text go once, in the exchange that the join needs: texts are smaller than sets.
    texts = marked(texts, "_print", wanted).where("_marked").drop("_marked").dropDuplicates(["_key", "_print"])
    texts = texts.join(wanted, ["_key", "_print"]).select("node", "text")
    return materialize(texts.mapInArrow(make, "node long, set binary"))


def _confirm_in_tiles(possible: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` among the partners of each tile, decided on full sets.

    A set comes once to each tile that needs it. Links that a tile has already implied
    are not tested again, so what leaves a tile is fewer links than it has nodes. Tiles
    are bounded in members and in shingles, so their sets fit in memory.
    """
    possible = materialize(possible)
    sets = _sets(docs, possible.select("node").distinct(), reps, key, text, size)
    dealt = possible.join(sets, "node").repartition(*GROUP).sortWithinPartitions(*GROUP, "node")

    def run(batches):
        for rows, starts in whole_groups(batches, GROUP):
            a, b = [], []
            nodes, comps, partners = (rows.column(c).to_pylist() for c in ("node", "comp", "partners"))
            sets_ = rows.column("set").combine_chunks() if rows.num_rows else []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                at = {nodes[k]: k for k in range(start, end)}
                parent = {comps[k]: comps[k] for k in range(start, end)}

                def find(x):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for k in range(start, end):
                    own = np.frombuffer(sets_[k].as_buffer(), np.uint64)
                    for other in partners[k]:
                        x, y = find(comps[k]), find(comps[at[other]])
                        if x != y and _together(own, np.frombuffer(sets_[at[other]].as_buffer(), np.uint64), percent):
                            parent[max(x, y)] = min(x, y)
                            a.append(nodes[k])
                            b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = materialize(dealt.mapInArrow(run, "a long, b long"))
    discard(sets)
    discard(possible)
    return links


def judged(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """``(key, print, n, group, component)`` of each row: its class's group, and the smallest key of that.

    ``group`` is null for rows without a key or without shingles.
    """
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    # Rows get numbers once they are written: a class is named by one of its rows, not by a key, which others may share.
    sk = materialize(sketch(docs, key, text, size).withColumn("row", F.monotonically_increasing_id()))
    whole = sk.where(F.col("key").isNotNull() & F.col("set_id").isNotNull())
    classes = materialize(whole.groupBy("set_id").agg(F.min(F.struct("key", "row")).alias("m"), F.count("*").alias("rows")).select("set_id", F.col("m.row").alias("node"), F.col("m.key").alias("least"), "rows"))
    # Most classes are one row, which stands for itself; only rows of the others are looked for.
    whole = marked(whole, "set_id", classes.where("rows > 1").select("set_id"))
    found = whole.where("_marked").join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(*whole.columns)
    reps = materialize(whole.where("NOT _marked").unionByName(found).select(F.col("row").alias("node"), "key", "print", "n", "regs", "bands"))
    entries = reps.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    heads = entries.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    buckets = materialize(entries.join(heads, "bucket"))
    stars = buckets.where(F.col("node") != F.col("head")).groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    best = materialize(stars.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b"))
    first = confirm(materialize(estimated(best, reps, percent)), reps, docs, key, text, size, percent)
    parts = components(first)
    labelled = materialize(
        buckets.join(parts, "node", "left").select("bucket", "band", "node", "n", "size", "shingles", F.coalesce("component", "node").alias("comp"))
    )
    sizes = labelled.groupBy("bucket", "comp").agg(F.count("*").alias("members"), F.sum("n").alias("mass"))
    mains = sizes.groupBy("bucket").agg(F.max(F.struct("members", "comp", "mass")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
    members = labelled.join(mains.select("bucket", "m"), "bucket").withColumn("main", F.col("m.comp") == F.col("comp"))
    members = members.withColumn("strays", F.col("size") - F.col("m.members")).withColumn("stray_shingles", F.col("shingles") - F.col("m.mass")).drop("m")
    members = materialize(members)
    regs = marked(reps.select("node", "regs"), "node", members).where("_marked").drop("_marked")
    second = _confirm_in_tiles(_possible(members.join(regs, "node"), percent), reps, docs, key, text, size, percent)
    for done in (reps, buckets, best, labelled, members):
        discard(done)
    parts = components(first.unionByName(second))
    # A group is named by the smallest key of all its classes; most classes are groups of their own.
    linked = materialize(classes.join(parts, "node"))
    names = linked.groupBy("component").agg(F.min("least").alias("name"))
    linked = linked.join(names, "component").select("set_id", F.col("component").alias("grouped"), "name")
    named = classes.join(linked, "set_id", "left").select("set_id", F.coalesce("grouped", "node").alias("group"), F.coalesce("name", "least").alias("name"))
    out = sk.select("key", "print", "n", F.when(F.col("key").isNotNull(), F.col("set_id")).alias("set_id")).join(named, "set_id", "left")
    return out.select("key", "print", "n", "group", F.when(F.col("key").isNotNull(), F.coalesce("name", "key")).alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``: one row per document.

    Rows with equal shingle sets are one class. Each class puts one entry in each of
    its bands; in a bucket every class is paired with the first, and of these pairs the
    one that shares most bands is estimated from the registers and then confirmed on
    full sets. Where a bucket still holds more than one component, all members outside
    its largest are held against all its members by their registers, in tiles, and what
    the estimate allows is decided on full sets in the same tiles. So a group of copies
    costs one pair each, no pair of a bucket stays undecided, none is capped, and no
    list of all pairs is made. Keys are integers; a component is named by its smallest key.

    A text without words has no shingles and is linked with nothing, also with another
    such text. Rows with a null key get a null component and are kept. Rows that repeat a
    key are judged each by its own text, so they may have different components. Extra
    columns are not read; an empty table gives no rows.
    """
    rows = judged(docs, key, text, size, percent)
    return rows.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("key"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near duplicates left.

    What stays is the row with the smallest key, then text fingerprint. Rows that agree
    in both are one document, and one of them stays. Rows without a key or without words
    are in no group and all stay. All columns stay.
    """
    rows = materialize(judged(docs, key, text, size, percent).where("group IS NOT NULL").select("key", "print", "group"))
    # Singletons are most of the table: only groups and repeated rows are looked at.
    several = rows.groupBy("group").agg(F.min(F.struct("key", "print")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    grouped = rows.join(several.select("group", "first"), "group").groupBy("key", "print").agg(F.min(F.struct("key", "print") == F.col("first")).alias("stays"), F.count("*").alias("n"))
    touched = materialize(grouped.where("NOT stays OR n > 1").select(F.col("key").alias("_key"), F.col("print").alias("_print"), "stays"))
    # The texts of all other rows pass where they are read; only marked ones are shuffled, if any.
    named = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("_key"), text_print(F.col(text)).alias("_print"))
    named = marked(named, "_print", touched)
    passed, looked = named.where("NOT _marked").select("doc.*"), named.where("_marked").drop("_marked")
    out = passed.unionByName(looked.join(touched, ["_key", "_print"], "left_anti").select("doc.*"))
    if touched.where("stays").limit(1).count():
        again = looked.join(touched.where("stays"), ["_key", "_print"], "left_semi").dropDuplicates(["_key", "_print"])
        out = out.unionByName(again.select("doc.*"))
    discard(rows)
    return out


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)
