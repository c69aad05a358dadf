"""BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafquire.llm.shared import fresh, table

TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that are merged and passed on together, and words remembered with their ids.
#: Both bound memory only; every word of every text is encoded.
TEXT_BLOCK = 500_000
REMEMBERED = 100_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer files of this installation keep ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter for each byte, by the rule of byte-level tokenizers."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 0
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


@dataclass
class Vocabulary:
    """What one tokenizer file says, as arrays."""

    tokens: list[str]  # by id
    inner: np.ndarray  # id of each byte inside a word
    final: np.ndarray  # id of each byte at a word's end
    keys: np.ndarray  # left * 2**32 + right of each merge, sorted
    ranks: np.ndarray  # rank of each key
    merged: np.ndarray  # id that each rank makes
    special: dict[str, int]
    pieces: regex.Pattern

    @classmethod
    def read(cls, text: str) -> Vocabulary:
        spec = json.loads(text)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        letters = byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(
            tokens, np.array([vocab[c] for c in letters], np.int64), np.array([vocab[c + suffix] for c in letters], np.int64),
            keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64),
            special, regex.compile(split["pattern"]["Regex"]),
        )


def split_words(vocab: Vocabulary, text: str) -> list[str | int]:
    """A text's pieces in order; special tokens, found before anything else, as their ids."""
    out: list[str | int] = []
    parts = [text]
    if any(s in text for s in vocab.special):
        parts = regex.split("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")", text)
    for part in parts:
        if part in vocab.special:
            out.append(vocab.special[part])
        elif part:
            # Capital sigma has one small form here, wherever it stands.
            out += vocab.pieces.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
    return out


def merge_words(vocab: Vocabulary, words: list[str]) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers.

    All words lie in one linked array of symbols. An index holds, for each active
    rank, the positions of its pair; ranks are applied in ascending order, each to all
    its positions at once, and only pairs next to a merge are looked up again. A merge
    can only enable higher ranks, because both its sides must have been made before.
    """
    if not words:
        return []
    raw = [w.encode("utf-8") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    symbol = vocab.inner[data]
    symbol[ends - 1] = vocab.final[data[ends - 1]]
    following = np.arange(1, n + 1)
    following[ends - 1] = n  # the place n is the end of every word
    before = np.arange(-1, n)
    before[np.concatenate(([0], ends[:-1]))] = n
    symbol, following = np.append(symbol, -1), np.append(following, n)
    waiting: list[int] = []
    places: dict[int, list[np.ndarray]] = {}

    def note(at: np.ndarray) -> None:
        nxt = following[at]
        at, nxt = at[nxt < n], nxt[nxt < n]
        key = symbol[at] << 32 | symbol[nxt]
        found = np.minimum(np.searchsorted(vocab.keys, key), len(vocab.keys) - 1)
        hit = vocab.keys[found] == key
        at, rank = at[hit], vocab.ranks[found[hit]]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, group in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
            if r not in places:
                places[r] = []
                heapq.heappush(waiting, r)
            places[r].append(group)

    note(np.arange(n))
    alive = np.ones(n + 1, bool)
    pair_of = np.empty(len(vocab.keys), np.int64)
    pair_of[vocab.ranks] = vocab.keys
    while waiting:
        r = heapq.heappop(waiting)
        groups = places.pop(r)
        at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
        a, b = pair_of[r] >> 32, pair_of[r] & 0xFFFFFFFF
        at = at[alive[at] & (symbol[at] == a)]
        at = at[symbol[following[at]] == b]
        if a == b and len(at) > 1:  # overlaps: from the left, every second of a run
            at = np.sort(at)
            begins = np.concatenate(([True], following[at[:-1]] != at[1:]))
            start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        if not len(at):
            continue
        gone = following[at]
        after = following[gone]
        symbol[at] = vocab.merged[r]
        alive[gone] = False
        symbol[gone] = -2
        following[at] = after
        inside = after < n
        before[after[inside]] = at[inside]
        left = before[at]
        note(np.unique(np.concatenate((left[left < n], at))))
    keep = alive[:n]
    ids = symbol[:n][keep].astype("<u4")
    counts = np.add.reduceat(keep.astype(np.int64), np.concatenate(([0], ends[:-1])))
    stop = np.cumsum(counts) * 4
    flat = ids.tobytes()
    return [flat[e - c * 4 : e] for e, c in zip(stop.tolist(), counts.tolist())]


class Encoder:
    """Encodes texts block by block, remembering a bounded number of words."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, {}

    def block(self, texts: list[str | None]) -> list[bytes]:
        split = [split_words(self.vocab, t) if t else [] for t in texts]
        new = {w for ws in split for w in ws if w not in self.known}
        numbers = [w for w in new if isinstance(w, int)]
        new = list(new.difference(numbers))
        self.known.update(zip(new, merge_words(self.vocab, new)))
        self.known.update((i, int(i).to_bytes(4, "little")) for i in numbers)
        known = self.known
        out = [b"".join([known[w] for w in ws]) for ws in split]
        if len(known) > REMEMBERED:
            self.known = {}
        return out


def _blocks(batch: pa.RecordBatch, text: str):
    """A batch's rows in slices of at most ``TEXT_BLOCK`` bytes of text; a longer text is one of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + TEXT_BLOCK, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


@lru_cache(maxsize=2)
def _vocabulary(file: str) -> Vocabulary:
    with open(SparkFiles.get(file), encoding="utf-8") as f:
        return Vocabulary.read(f.read())


def encoded(batches, vocab: Vocabulary, text: str, rest: list[int], names: list[str]):
    """The columns ``rest`` of each block of rows and the ids of its texts, under ``names``."""
    encoder = Encoder(vocab)
    for batch in batches:
        for block in _blocks(batch, text):
            parts = encoder.block(block.column(text).to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            column = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*map(block.column, rest), column], names=names)


def _share(df: DataFrame, path: str) -> str:
    """Send the tokenizer file, a fixed few MB, to all executors; its name there."""
    context = df.sparkSession.sparkContext
    name = path.rsplit("/", 1)[-1]
    if name not in {p.rsplit("/", 1)[-1] for p in context.listFiles}:
        context.addFile(path)
    return name


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """Add ``ids array<int>``: the whole text's token ids, special tokens of a text included.

    Null and empty texts have no ids. Other columns stay, the text unless ``keep_text`` is
    false; a column named ``ids`` is replaced. A map over partitions; a very long text, even
    one without spaces, costs time in proportion to its length times the logarithm of it.
    Rows leave a task in blocks of ``TEXT_BLOCK`` bytes of text, so it holds the ids of one
    block, not of a batch.
    """
    file = _share(df, path or tokenizer_path())
    df = df.drop(ids) if ids != text else df
    rest = [i for i, c in enumerate(df.columns) if c != ids and (keep_text or c != text)]
    schema = T.StructType([*map(df.schema.fields.__getitem__, rest), T.StructField(ids, T.ArrayType(T.IntegerType(), False), True)])
    return df.mapInArrow(lambda batches: encoded(batches, _vocabulary(file), text, rest, schema.names), schema)


def _joined(column: pa.ListArray, tokens: pa.StringArray) -> pa.StringArray:
    """The text of each row's ids; ids outside the vocabulary are left out."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    known = (values >= 0) & (values < len(tokens))
    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[known], minlength=len(counts))
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens.take(pa.array(values[known]))), " ")


def _slices(batch: pa.RecordBatch, rows: int = 256):
    for start in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(start, rows)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``text``: the tokens of ``ids`` joined by one space, special tokens included.

    No or null ids give the empty text; ids outside the vocabulary are left out. Other
    columns stay; a column named like the new one is replaced.
    """
    file = _share(df, path or tokenizer_path())
    df = df.drop(text) if ids != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), True)])

    def run(batches):
        tokens = pa.array(_vocabulary(file).tokens)
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, _joined(part.column(ids), tokens)], names=[*part.schema.names, text])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Replace ``ids`` by ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The ids are hashed as little-endian unsigned 32-bit integers; they are decoded as
    ``decode`` does, and the text is hashed in UTF-8 where it is made.
    """
    file = _share(df, path or tokenizer_path())
    rest = [c for c in df.columns if c != ids]
    schema = T.StructType([
        *df.select(*rest).schema.fields, T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        tokens = pa.array(_vocabulary(file).tokens)
        for batch in batches:
            for part in _slices(batch):
                column = part.column(ids)
                counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                stops = np.cumsum(counts)
                of_ids = [sha(flat[e - c : e].tobytes()) for e, c in zip(stops.tolist(), counts.tolist())]
                of_text = [sha(t.as_buffer()) for t in _joined(column, tokens)]
                columns = [*map(part.column, rest), pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(*rest, ids).mapInArrow(run, schema)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    (ids,) = fresh(docs, "ids")
    return digests(encode(docs, ids=ids, keep_text=False), ids)
