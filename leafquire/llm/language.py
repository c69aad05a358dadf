"""Language of a text by cross-parsing entropy.

For each learned language a suffix automaton holds every stretch of its sample. A text is
parsed from left to right into the longest phrases that the automaton knows; the language
that needs the fewest phrases, times the bits that name a place in its sample, wins.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leafquire.llm.shared import fresh, materialize, table

UNKNOWN = "und"
#: Bounds of the labelled sample: rows of a language, characters of a row, bytes of a language.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 600
SAMPLE_BYTES = 48_000
#: Bytes of a lane. A text is parsed in lanes of this length, all lanes side by side.
LANE = 512
#: Bytes of text whose lanes are worked on together.
BLOCK = 4_000_000

_SPACE = 32
#: Capital ASCII letters become small ones; other ASCII characters but letters become spaces.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else _SPACE for c in range(256)], np.uint8)


@dataclass
class Model:
    """The samples of the learned languages, in the order of their names."""

    languages: list[str]
    samples: list[bytes]

    @property
    def digest(self) -> str:
        return hashlib.md5(repr((self.languages, self.samples)).encode()).hexdigest()


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in small letters with one space for each stretch of other signs, and which bytes were kept."""
    data = _FOLD[data]
    space = data == _SPACE
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return data[keep], keep


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that reads every stretch of ``text``; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        depth.append(depth[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if depth[q] == depth[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                depth.append(depth[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Parser:
    """The automata of all languages as one table, read by many lanes at once.

    An entry holds four times the row of the next state plus the phrases that end: none
    if the automaton reads on, one if a phrase ends and the byte begins the next, one
    more if the sample lacks the byte, which then is a phrase of its own.
    """

    def __init__(self, model: Model):
        used = sorted(set().union(*map(set, model.samples)) | {_SPACE})
        self.class_of = np.zeros(256, np.int64)  # 0: a byte that no sample has
        self.class_of[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        parts, self.roots, base = [], [], 0
        for sample in model.samples:
            automaton = suffix_automaton(sample)
            where = np.repeat(np.arange(len(automaton)), [len(s) for s in automaton])
            what = self.class_of[np.fromiter((c for s in automaton for c in s), np.int64, len(where))]
            target = np.fromiter((t for s in automaton for t in s.values()), np.int64, len(where))
            root = base * width
            first = np.full(width, 4 * root + 1, np.int64)  # from the start: lacking bytes are phrases
            at_root = where == 0
            first[what[at_root]] = 4 * (base + target[at_root]) * width
            table = np.tile(first + 1, (len(automaton), 1))
            table[0] = first
            table[where, what] = 4 * (base + target) * width
            self.roots.append(root)
            parts.append(table)
            base += len(automaton)
        self.table = np.concatenate(parts).ravel()
        if 4 * self.table.size < 2**31:
            self.table = self.table.astype(np.int32)
        self.bits = np.array([math.log2(max(2, len(s))) for s in model.samples])

    def phrases(self, data: np.ndarray, starts: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.diff(np.append(starts, len(data)))
        lanes = -(-sizes // lane)
        of = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[of] + nth * lane
        length = np.minimum(lane, sizes[of] - nth * lane)
        order = np.argsort(-length, kind="stable")
        begin, length, of = begin[order], length[order], of[order]
        active = np.searchsorted(-length, -np.arange(lane), side="left")  # lanes that are longer than t
        codes = self.class_of[data]
        out = np.zeros((len(sizes), len(self.roots)), np.int64)
        for g, root in enumerate(self.roots):
            state = np.full(len(of), root, np.int64)
            count = np.zeros(len(of), np.int64)
            for t in range(int(length[0]) if len(of) else 0):
                n = active[t]
                entry = self.table[state[:n] + codes[begin[:n] + t]]
                count[:n] += entry & 3
                state[:n] = entry >> 2
            count += state != root
            out[:, g] = np.bincount(of, weights=count, minlength=len(sizes))
        return out


_PARSERS: dict[str, Parser] = {}


def _parser(model: Model) -> Parser:
    """One parser for each worker, however many of its tasks need it."""
    if model.digest not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[model.digest] = Parser(model)
    return _PARSERS[model.digest]


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its decimal key is a multiple of five; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = SAMPLE_BYTES) -> Model:
    """Samples of each language from labelled rows.

    About twice ``rows`` different texts of a language are picked by a hash of the text,
    so copies count once, and the first ``rows`` of them in the order of the hash give
    ``chars`` characters each, from a place that the hash picks; ``size`` bytes of those
    stay. Rows with a null label, or without a letter, teach nothing. The model grows with
    the number of languages, not of rows. Without labelled rows there are no languages.
    """
    t, label = F.col(text), F.col(lang)
    known = docs.where(label.isNotNull() & t.rlike(r"\p{L}")).select(label.alias("label"), t.alias("body"))
    counts = materialize(known.groupBy("label").agg(F.count("*").alias("n")))
    share = F.lit(2.0 * rows) / F.col("n")
    mark = F.pmod(F.xxhash64("body", F.lit(5)), F.lit(1 << 50))
    picked = known.join(counts.withColumn("share", share), "label").where(mark < F.least(F.lit(1.0), F.col("share")) * (1 << 50))
    place = F.pmod(F.xxhash64("body", F.lit(11)), F.greatest(F.lit(1), F.length("body") - chars + 1)).cast("int") + 1
    picked = picked.select("label", mark.alias("mark"), F.substring(F.col("body"), place, F.lit(chars)).alias("piece")).distinct()
    first = picked.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy("mark", "piece"))).where(F.col("nth") <= rows)
    pieces: dict[str, list[bytes]] = {}
    for r in first.orderBy("label", "nth").toArrow().to_pylist():
        pieces.setdefault(r["label"], []).append(r["piece"].lower().encode())
    languages = sorted(pieces)
    samples = [folded(np.frombuffer(b" ".join(pieces[x]), np.uint8))[0][:size].tobytes() for x in languages]
    return Model(languages, samples)


def identify(df: DataFrame, model: Model, text: str = "text", language: str = "lang_pred", score: str = "score", block: int = BLOCK) -> DataFrame:
    """Add the language of each text and how sure the parse is of it.

    Texts are read whole, in small letters, with one space for all that is no letter of
    ASCII and one byte for each byte of other signs, in lanes of ``LANE`` bytes where a
    phrase ends at the latest. The score compares the bits of all languages' phrases as
    chances, 1 if no other language is near. Texts that are null or have no letter, and
    all texts if no language was learned, get ``und`` and 0; of languages that tie the
    first by name wins. Rows are independent: repeated rows get equal results and an empty table stays
    empty. Other columns stay; columns named like the new ones are replaced.
    """
    rest = [c for c in df.columns if c not in (language, score)]
    if not model.languages:
        return df.select(*rest).withColumn(language, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    (lettered,) = fresh(df, "lettered")
    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        parser = _parser(model)
        names = pa.array(model.languages)
        for batch in batches:
            for part in _parts(batch, text, block):
                phrases = _phrases(parser, part.column(text))
                bits = phrases * parser.bits
                best = np.argmin(bits, 1)
                ahead = np.minimum(bits - bits.min(1, keepdims=True), 60)
                sure = 1 / (2.0 ** -ahead).sum(1)
                has = pc.fill_null(part.column(lettered), False).to_numpy(zero_copy_only=False)
                found = pc.if_else(pa.array(has), names.take(pa.array(best)), UNKNOWN)
                yield pa.RecordBatch.from_arrays([*map(part.column, rest), found, pa.array(np.where(has, sure, 0.0))], names=[*rest, language, score])

    return df.withColumn(lettered, F.col(text).rlike(r"\p{L}")).select(*dict.fromkeys([*rest, text, lettered])).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, text: str, block: int):
    """Slices of a batch of about ``block`` bytes of text; one text stays whole."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + block, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _phrases(parser: Parser, column: pa.Array) -> np.ndarray:
    lowered = pc.utf8_lower(pc.fill_null(column, "")).cast(pa.large_binary())
    sizes = pc.binary_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.frombuffer(lowered.buffers()[1], np.int64, len(lowered) + 1, lowered.offset * 8)[0]
    total = int(sizes.sum())
    data = np.frombuffer(lowered.buffers()[2], np.uint8, total, first) if total else np.zeros(0, np.uint8)
    data, keep = folded(data)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    before = np.concatenate(([0], np.cumsum(keep)))
    return parser.phrases(data, before[starts])


def op12_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out; a row with a null id is never held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
