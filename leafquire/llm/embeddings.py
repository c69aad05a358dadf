"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafquire.llm.shared import about, components, materialize, table, whole_groups

COSINE = 0.9
#: The rotations are learned from about this many vectors; every vector is indexed.
SAMPLE = 20_000
ROUNDS = 30
#: Share of the pairs exactly at the threshold that the index may miss.
MISS = 0.005
#: Bits of a vector's code; tables look at some of them, and the Hamming distance counts all.
BITS = 256
#: A row in a table costs about as much as this many comparisons of codes; bits and tables follow from it.
ROW_COST = 200
#: Larger buckets are compared in tiles of about this many codes.
TILE = 4096
#: Groups up to this size are compared many at a time; pairs are taken in arrays of this length.
SMALL, PAIRS = 64, 1 << 15


def learn_rotations(sample: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centre and ``count`` rotations by iterative quantisation.

    Each starts from the principal axes turned at random, then alternates between the
    nearest binary codes and the rotation that fits them best (orthogonal Procrustes).
    """
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    centre = sample.mean(0) if len(sample) else np.zeros(width)
    moved = sample - centre
    axes = np.linalg.eigh(moved.T @ moved + 1e-9 * np.eye(width))[1][:, ::-1]
    turned = moved @ axes
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds if len(sample) > width else 0):
            u, _, vt = np.linalg.svd(np.where(turned @ r >= 0, 1.0, -1.0).T @ turned)
            r = (u @ vt).T
        out.append(axes @ r)
    return centre, np.stack(out)


def threshold_pairs(sample: np.ndarray, cosine: float = COSINE, most: int = 4000, seed: int = 13) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at or just over ``cosine``, by kind, on which recall is measured.

    Sampled vectors with a partner exactly at ``cosine``, turned in any direction or
    towards another sampled vector; and pairs of the sample itself, if it holds enough.
    """
    rng = np.random.default_rng(seed)
    if len(sample) < 2 or sample.shape[1] < 2:
        return []
    x = sample[rng.integers(0, len(sample), most)]
    out = []
    for w in (rng.standard_normal(x.shape), sample[rng.integers(0, len(sample), most)]):
        w = w - (w * x).sum(1, keepdims=True) * x
        size = np.sqrt((w * w).sum(1, keepdims=True))
        good = size[:, 0] > 1e-6
        out.append((x[good], cosine * x[good] + math.sqrt(1 - cosine * cosine) * w[good] / size[good]))
    rows = sample[rng.permutation(len(sample))[:2048]]
    a, b, found = [], [], 0
    for k in range(0, len(rows), 256):
        i, j = np.nonzero(np.abs(rows[k : k + 256] @ sample.T - cosine - 0.01) <= 0.01)
        kept = rng.permutation(len(i))[: most // 8]
        a.append(rows[k + i[kept]])
        b.append(sample[j[kept]])
    out.append((np.concatenate(a), np.concatenate(b)))
    return [(a, b) for a, b in out if len(a) >= 200]


def codes_of(unit: np.ndarray, rotations: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The binary codes of unit vectors, ``BITS`` bits in 64-bit words: the side of each learned plane they are on."""
    width, left = unit.shape[1], BITS
    out = []
    for r, o in zip(rotations, offsets):
        take = min(width, left)
        out.append(unit @ r[:, :take] >= o[:take])
        left -= take
    return np.packbits(np.concatenate(out, 1), axis=1, bitorder="little").view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


def masks(bits: int, tables: int) -> np.ndarray:
    """For each table the bits of a code that it looks at: ``bits`` of them, drawn by a fixed rule."""
    rng = np.random.default_rng(29)
    chosen = np.zeros((tables, BITS), bool)
    for t in range(tables):
        chosen[t, rng.permutation(BITS)[:bits]] = True
    return np.packbits(chosen, axis=1, bitorder="little").view(np.uint64)


def bucket_of(codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A 64-bit key of the masked code: equal codes, equal keys; the rest meet once in 2**64."""
    x = np.zeros(len(codes), np.uint64)
    for word in range(codes.shape[1]):
        x = (x ^ (codes[:, word] & mask[word])) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


@dataclass
class Index:
    """Planes, tables and the greatest Hamming distance of a candidate."""

    rotations: np.ndarray
    offsets: np.ndarray
    masks: np.ndarray
    most: int


def fit_index(sample: np.ndarray, count: int, cosine: float = COSINE, miss: float = MISS) -> Index:
    """Learn the planes, then plan tables for ``count`` vectors such that the measured recall holds.

    On ``threshold_pairs`` it is measured how far codes differ. The greatest distance is
    set so that a tenth of ``miss`` lies beyond it. A table of b bits holds a pair at
    distance d with chance C(BITS - d, b) / C(BITS, b); of all b the one is taken whose
    tables cost least: a row each, and comparisons with the others of its bucket. So b
    grows with the logarithm of ``count``, without a stop, and the number of tables with
    a power of it below one. Then tables are added until the pairs themselves are found.
    """
    width = sample.shape[1]
    centre, rotations = learn_rotations(sample, math.ceil(BITS / width))
    offsets = centre @ rotations
    pairs = threshold_pairs(sample, cosine)
    codes = [(codes_of(a, rotations, offsets), codes_of(b, rotations, offsets)) for a, b in pairs]
    far = [distances(a, b) for a, b in codes]
    most = min(BITS, 2 + int(max((np.quantile(d, 1 - miss / 10) for d in far), default=BITS)))
    best = None
    for bits in range(4, 65):
        d = np.arange(BITS + 1)
        held = np.exp(sum(np.log(np.maximum(BITS - d - i, 1e-9) / (BITS - i)) for i in range(bits)))
        needed = max((_tables_for(held[x], miss) for x in far), default=1)
        cost = needed * (ROW_COST + count / 2.0**bits / 2)
        if best is None or cost < best[0]:
            best = cost, bits, needed
    _, bits, tables = best
    while True:
        chosen = masks(bits, tables)
        found = [((((a ^ b)[:, None, :] & chosen) == 0).all(2).any(1) & (distances(a, b) <= most)).mean() for a, b in codes]
        if all(x >= 1 - miss for x in found):
            return Index(rotations, offsets, chosen, most)
        tables += max(1, tables // 16)


def _tables_for(chance: np.ndarray, miss: float) -> int:
    """The number of tables in which all but ``miss`` / 2 of the pairs meet, each with its ``chance`` a table."""
    lost = lambda n: ((1 - chance) ** n).mean()
    n = 1
    while lost(n) > miss / 2 and n < 1 << 20:
        n *= 2
    low = n // 2
    while n - low > 1:
        mid = (n + low) // 2
        low, n = (mid, n) if lost(mid) > miss / 2 else (low, mid)
    return n


def usable(vector):
    """Whether a vector (a column) can be compared: not null, finite throughout, not zero."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(flat: np.ndarray, width: int) -> np.ndarray:
    """Vectors of length one, in double precision; scaling first keeps squares finite."""
    v = flat.reshape(-1, width).astype(float)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least place that the links ``a - b`` reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def blob(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def new_in(t: int, difference: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Pairs of a bucket of table ``t`` that no earlier table holds, from the bits in which they differ."""
    out = np.ones(len(difference), bool)
    for mask in masks[:t]:
        out &= (difference & mask).any(1)
    return out


def _checked(t: np.ndarray, a: np.ndarray, b: np.ndarray, codes: np.ndarray, index: Index):
    """Of pairs of places those that are near by Hamming distance and new in their table."""
    d = codes[a] ^ codes[b]
    good = np.bitwise_count(d).sum(1) <= index.most
    a, b, d = a[good], b[good], d[good]
    of, keep = t[a], np.zeros(len(a), bool)
    for table in np.unique(of).tolist():
        at = np.flatnonzero(of == table)
        keep[at] = new_in(table, d[at], index.masks)
    return a[keep], b[keep]


GROUP = ["t", "bucket", "i", "j"]


def candidate_pairs(rows: pa.Table, starts: np.ndarray, codes: np.ndarray, index: Index):
    """All candidates of the groups in ``rows``, as arrays of places that are bounded in size.

    A group is a bucket, or a tile of a large one: one part with itself, or two parts.
    """
    t, i, j, own = (rows.column(c).to_numpy() for c in ("t", "i", "j", "own"))
    size = np.diff(np.append(starts, rows.num_rows))
    small = (size <= SMALL) & (i[starts] == j[starts])
    for s in np.unique(size[small & (size > 1)]).tolist():  # groups of one size are taken together
        x, y = np.triu_indices(s, 1)
        which, step = starts[small & (size == s)], max(1, PAIRS // len(x))
        for k in range(0, len(which), step):
            at = which[k : k + step, None]
            yield _checked(t, (at + x).ravel(), (at + y).ravel(), codes, index)
    for start, end in zip(starts[~small].tolist(), (starts + size)[~small].tolist()):
        at = np.arange(start, end)
        same = i[start] == j[start]
        left, right = (at, at) if same else (at[own[at] == i[start]], at[own[at] == j[start]])
        step = max(1, (1 << 20) // max(1, len(right)))
        for k in range(0, len(left), step):
            far = np.zeros((len(left[k : k + step]), len(right)), np.uint16)
            for word in range(codes.shape[1]):
                far += np.bitwise_count(codes[left[k : k + step], None, word] ^ codes[right, word])
            x, y = np.nonzero(far <= index.most)
            a, b = left[k + x], right[y]
            if same:
                a, b = a[a < b], b[a < b]
            for p in range(0, len(a), PAIRS):
                yield _checked(t, a[p : p + PAIRS], b[p : p + PAIRS], codes, index)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "own", "node")


def _candidates(coded: DataFrame, model) -> DataFrame:
    """``(t, bucket, i, j, own, node)``: the vectors of each tile that have a candidate there.

    Only codes go to the tables. Large buckets are cut into parts; every two parts meet
    in a tile of bounded size, so a hot bucket is many tasks.
    """

    def keys(with_code: bool):
        def run(batches):
            index = model.value
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    codes = blob(part.column("code"), np.uint64).reshape(-1, BITS // 64)
                    again = pa.array(np.tile(np.arange(part.num_rows), len(index.masks)))
                    columns = [pa.array(np.repeat(np.arange(len(index.masks), dtype=np.int32), part.num_rows)), pa.array(np.concatenate([bucket_of(codes, m) for m in index.masks]))]
                    columns += [part.column(c).take(again) for c in ("node", "code")] if with_code else []
                    yield pa.RecordBatch.from_arrays(columns, names=["t", "bucket", "node", "code"][: len(columns)])

        return run

    sizes = coded.mapInArrow(keys(False), "t int, bucket long").groupBy("t", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    rows = coded.mapInArrow(keys(True), "t int, bucket long, node long, code binary").join(materialize(sizes), ["t", "bucket"], "left")
    parts = F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int")
    # A row of part p goes to one tile for each part q: (p, q) or (q, p).
    tiled = rows.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    tiled = tiled.select("t", "bucket", F.least("own", "q").alias("i"), F.greatest("own", "q").alias("j"), "own", "node", "code")

    def run(batches):
        index = model.value
        for rows, starts in whole_groups(batches, GROUP):
            needed = np.zeros(rows.num_rows, bool)
            for a, b in candidate_pairs(rows, starts, blob(rows.column("code"), np.uint64).reshape(-1, BITS // 64), index):
                needed[a] = needed[b] = True
            yield from rows.select([*GROUP, "own", "node"]).filter(pa.array(needed)).combine_chunks().to_batches()

    return _dealt(tiled).mapInArrow(run, "t int, bucket long, i int, j int, own int, node long")


def _links(found: DataFrame, coded: DataFrame, model, width: int, kind: str, cosine: float) -> DataFrame:
    """``(node, near, other)``: weighted link counts, and a spanning set of each tile's links.

    The vectors of candidates, and only they, come to their tiles and are compared by
    cosine in double precision. What leaves a tile is counts and at most one link a
    vector, so no list of pairs is made.
    """

    def run(batches):
        index = model.value
        for rows, starts in whole_groups(batches, GROUP):
            node, n = (rows.column(c).to_numpy() for c in ("node", "n"))
            unit = unit_rows(blob(rows.column("vector"), kind), width)
            near, label = np.zeros(rows.num_rows), np.arange(rows.num_rows)
            for a, b in candidate_pairs(rows, starts, blob(rows.column("code"), np.uint64).reshape(-1, BITS // 64), index):
                good = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                a, b = a[good], b[good]
                near += np.bincount(a, n[b], rows.num_rows) + np.bincount(b, n[a], rows.num_rows)
                apart = label[a] != label[b]
                if apart.any():
                    label = reachable(rows.num_rows, label[a][apart], label[b][apart])[label]
            counted, tied = np.flatnonzero(near > 0), np.flatnonzero(label != np.arange(rows.num_rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((node[counted], node[tied]))), pa.array(np.concatenate((near[counted].astype(np.int64), np.zeros(len(tied), np.int64)))),
                 pa.array(np.concatenate((node[counted], node[label[tied]])))],
                names=["node", "near", "other"],
            )

    return _dealt(found.join(coded, "node")).mapInArrow(run, "node long, near long, other long")


def _of_width(classes: DataFrame, width: int, count: int, kind: str, cosine: float, sample: int) -> DataFrame:
    """``(node, near, other)`` among the classes of one width."""
    context = classes.sparkSession.sparkContext
    same = classes.where(F.size("vector") == width).select("node", "n", "vector")
    picked = same.where(about(sample / count, F.col("node"))).limit(2 * sample).toArrow()
    data = unit_rows(picked.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), width) if picked.num_rows else np.empty((0, width))
    model = context.broadcast(fit_index(data, count, cosine))  # BITS planes, and a mask a table

    def run(batches):
        index = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind)
                codes = codes_of(unit_rows(flat, width), index.rotations, index.offsets)
                rows = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (flat.reshape(-1, width), codes)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), *rows], names=["node", "n", "vector", "code"])

    coded = materialize(same.mapInArrow(run, "node long, n long, vector binary, code binary"))
    return _links(_candidates(coded.select("node", "code"), model), coded, model, width, kind, cosine)


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """``(key, n_links, component_id, kept)``: one row per vector.

    Equal vectors are one class with a count. Each class gets one balanced binary code
    from learned rotations; each table looks at some bits of it, and vectors that agree
    there share a bucket. Inside a bucket codes are compared by their Hamming distance
    over all bits; only vectors with a candidate are fetched, and candidates are compared
    by cosine. A pair counts in the first table that holds it.

    Vectors that are null, zero, or hold null or non-finite parts have no links, as have
    rows with a null key (their component is null). Vectors of different widths are not
    compared; each width has tables of its own. A repeated row counts as another vector,
    and so does another vector under the same key; a component is named by its smallest
    key. Extra columns are not read; an empty table gives no rows.
    """
    kind = "<f4" if df.schema[vector].dataType.elementType == T.FloatType() else "<f8"
    v = F.col("vector")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"))
    prints = [F.xxhash64("vector", F.lit(s)).alias(f"p{s}") for s in (1, 2)]
    rows = rows.select("key", "vector", *[F.when(usable(v) & F.col("key").isNotNull(), p).alias(f"p{s}") for s, p in zip((1, 2), prints)])
    # Classes are numbered as they are written: keys may repeat with other vectors.
    classes = rows.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.any_value("vector").alias("vector"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    found = df.sparkSession.createDataFrame([], "node long, near long, other long")
    for r in classes.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).where("n > 1").collect():
        found = found.unionByName(_of_width(classes, r.width, r.n, kind, cosine, sample))
    found = materialize(found)
    near = found.where("near > 0").groupBy("node").agg(F.sum("near").alias("near"))
    groups = components(found.where("near = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    grouped = classes.select("node", "least").join(groups, "node")
    names = grouped.groupBy("component").agg(F.min("least").alias("name"))
    grouped = grouped.join(names, "component").select("node", "name")
    per_class = classes.select("p1", "p2", "node", "n", "least").join(near, "node", "left").join(grouped, "node", "left").select(
        "p1", "p2", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("name", "least").alias("component_id")
    )
    component = F.coalesce("component_id", "key")
    return rows.select("key", "p1", "p2").join(per_class, ["p1", "p2"], "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"),
    )


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
