"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafquire.llm.shared import about, materialize, table

THRESHOLD = 0.3
#: Weights are learned from about this many labelled rows, picked by a hash of their id.
SAMPLE = 12_000
PREFIXES = range(3, 8)
#: A learned pattern occurs in this share of toxic texts, with this many times as many words a
#: text as in others, and the two rates differ by so many standard errors.
SUPPORT, LIFT, ERRORS = 0.01, 5.0, 6.0
#: How far negation, reporting and a target reach, in words.
NEAR = 4
COUNTED = 200_000

# Seed words of each transducer, by what they do.
SEEDS = {
    "insult": (
        "idiot idiots moron morons stupid trash pathetic worthless disgusting clown clowns scum loser losers imbecile bastard dimwit scumbag "
        "vermin subhuman idiota estúpido estúpida imbécil basura asqueroso idiote stupide crétin connard ordure minable dummkopf vollidiot abschaum versager arschloch"
    ),
    "threat": "kill murder hurt destroy strangle stab matar matarte tuer étrangler töten umbringen erwürgen",
    "target": "you your yours yourself u they them he him she her people tú usted ustedes te vosotros tu toi vous eux du dich dir ihr euch sie",
    "negation": "not no never isn aren wasn don didn without nunca jamás ni pas jamais aucun nicht kein keine nie niemals",
    "report": "said says say called calls claimed wrote quoted alleged reported dijo dice llamó dit disait écrit sagte sagt nannte schrieb",
}
_LETTERS = re.compile(r"[^\W\d_]+")
_CLAUSE_ENDS = re.compile(r"[.!?;:\n|…。！？]")
_TOKENS = re.compile(r"[^\W\d_]+|[\"“”„«»]")
#: What a clause can say, in the order of the final weights.
KINDS = ("plain", "aimed", "negated", "reported", "threat")
ATTACKS = ("insult", "threat")
#: The grammar: one transducer a row, composed in this order. Where it acts on its signal,
#: the mark that it puts on attacks without one, and how many words it reaches (None: to the clause's end).
RULES = (
    ("after", "negation", "negated", NEAR),
    ("after", "report", "reported", None),
    ("between", "quote", "reported", None),
    ("beside", "target", "aimed", NEAR),
)
#: What a marked attack counts as; a threat without a target says nothing.
SAID = {"insult": "plain", "insult/aimed": "aimed", "threat/aimed": "threat", **{f"{a}/{m}": m for a in ATTACKS for m in ("negated", "reported")}}


@dataclass
class Transducer:
    """States and weighted arcs: ``arcs[state][symbol]`` lists ``(symbol out, weight, next state)``.

    A path reads a clause's symbols from ``start`` to one of ``finals``; of all paths the
    one with the greatest weight counts. A symbol without arcs ends a path.
    """

    start: Hashable
    arcs: dict[Hashable, dict[str, list[tuple[str, float, Hashable]]]]
    finals: set[Hashable]

    @classmethod
    def explore(cls, start: Hashable, symbols: Iterable[str], step: Callable, final: Callable = lambda state: True) -> Transducer:
        """The machine whose arcs ``step(state, symbol)`` lists, with all states that ``start`` reaches."""
        arcs, todo = {}, [start]
        while todo:
            state = todo.pop()
            if state not in arcs:
                arcs[state] = {x: out for x in symbols if (out := step(state, x))}
                todo += [to for out in arcs[state].values() for _, _, to in out]
        return cls(start, arcs, {s for s in arcs if final(s)})

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this machine writes is what the other one reads."""
        symbols = {x for arcs in self.arcs.values() for x in arcs}

        def step(state, x):
            a, b = state
            return [(z, v + w, (to, on)) for y, v, to in self.arcs[a].get(x, ()) for z, w, on in other.arcs[b].get(y, ())]

        return Transducer.explore((self.start, other.start), symbols, step, lambda s: s[0] in self.finals and s[1] in other.finals)

    def best(self, symbols: list[str]) -> list[str]:
        """What the path of greatest weight writes; ties go to the first arc."""
        paths = {self.start: (0.0, None)}
        for x in symbols:
            new: dict = {}
            for state, (weight, path) in paths.items():
                for y, w, to in self.arcs[state].get(x, ()):
                    if to not in new or weight + w > new[to][0]:
                        new[to] = weight + w, (y, path)
            paths = new
        path = max((p for s, p in paths.items() if s in self.finals), key=lambda p: p[0])[1]
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return out[::-1]


def transducer(where: str, signal: str, mark: str, reach: int | None) -> Transducer:
    """The machine of one row of ``RULES``."""
    symbols = ["word", *SEEDS, "quote", *(f"{a}/{m}" for a in ATTACKS for _, _, m, _ in RULES)]
    marked = lambda x: f"{x}/{mark}" if x in ATTACKS else x
    counts = lambda x: int(x != "quote")  # noqa: E731  quotes are no words

    def after(left, x):
        if x == signal:
            return [(x, 0.0, reach or -1)]
        return [(marked(x) if left else x, 0.0, left if left < 0 else max(0, left - counts(x)))]

    def between(inside, x):
        return [(marked(x) if inside else x, 0.0, not inside if x == signal else inside)]

    def beside(state, x):
        """Words since the last signal, and words in which one must come for the attacks that were marked before it."""
        since, due = state
        if x == signal:
            return [(x, 0.0, (0, 0))]
        if due and counts(x) and due == 1:
            return []
        then = (min(reach, since + counts(x)), due and due - counts(x))
        if x not in ATTACKS:
            return [(x, 0.0, then)]
        if since < reach:
            return [(marked(x), 1.0, then)]
        return [(x, 0.0, then), (marked(x), 1.0, (then[0], then[1] or reach))]

    if where == "beside":
        return Transducer.explore((reach, 0), symbols, beside, lambda s: not s[1])
    return Transducer.explore(0 if where == "after" else False, symbols, {"after": after, "between": between}[where])


@lru_cache
def grammar_machine() -> Transducer:
    """All rows of ``RULES``, composed."""
    return reduce(Transducer.then, (transducer(*row) for row in RULES))


@dataclass
class Grammar:
    """Patterns with weights (a trailing ``*`` matches any ending), and the weights of what clauses say."""

    patterns: dict[str, float]
    theta: np.ndarray = field(default_factory=lambda: np.array([-2.2, 1.6, 2.2, 0.5, 0.5, 2.0]))


class Transducers:
    """The lexicon, which turns words into weighted symbols, before the composed grammar.

    The lexicon runs over the whole text as one automaton. Only clauses in which it
    finds an insult or a threat go through the composition.
    """

    def __init__(self, grammar: Grammar):
        self.theta = grammar.theta
        self.machine = grammar_machine()
        self.words = {w: kind for kind, ws in SEEDS.items() if kind not in ("insult",) for w in ws.split()}
        self.whole = {p: w for p, w in grammar.patterns.items() if not p.endswith("*")}
        self.open = {p[:-1]: w for p, w in grammar.patterns.items() if p.endswith("*")}
        self.lengths = sorted({len(p) for p in self.open})
        self.automaton = ahocorasick.Automaton()
        for word in {*self.whole, *self.open, *SEEDS["threat"].split()}:
            self.automaton.add_word(word, (len(word), word not in self.open))
        self.automaton.make_automaton()

    def insult(self, word: str) -> float:
        best = self.whole.get(word, 0.0)
        for n in self.lengths:
            if n <= len(word):
                best = max(best, self.open.get(word[:n], 0.0))
        return best

    def symbol(self, token: str) -> tuple[str, float]:
        """What the lexicon writes for a token, and an attack's weight."""
        if not token[0].isalpha():
            return "quote", 0.0
        weight, kind = self.insult(token), self.words.get(token, "word")
        return ("insult", weight) if weight else (kind, float(kind in ATTACKS))

    def clause(self, text: str) -> dict[str, float]:
        """What a clause says, by kind, with its weight."""
        said = dict.fromkeys(KINDS, 0.0)
        tokens = [self.symbol(m[0]) for m in _TOKENS.finditer(text)]
        for (_, weight), out in zip(tokens, self.machine.best([x for x, _ in tokens])):
            if out in SAID:
                said[SAID[out]] += weight
        return said

    def matched(self, text: str) -> list[tuple[int, int, dict[str, float]]]:
        """The clauses in which the lexicon matches: start, end and what they say."""
        low = text.lower()
        out, done = [], -1
        for end, (length, whole) in self.automaton.iter(low):
            start = end - length + 1
            if start <= done or start and low[start - 1].isalpha() or whole and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            begin = max(done + 1, 0)
            for m in _CLAUSE_ENDS.finditer(low, begin, start):
                begin = m.end()
            stop = _CLAUSE_ENDS.search(low, end + 1)
            done = stop.start() if stop else len(low)
            said = self.clause(low[begin:done])
            if any(said.values()):
                out.append((begin, done, said))
        return out

    def features(self, text: str | None) -> tuple[list[float], list[tuple[int, int, dict[str, float]]]]:
        clauses = self.matched(text) if text else []
        sums = [sum(c[2][k] for c in clauses) for k in KINDS]
        return [math.log1p(x) for x in sums], clauses

    def score(self, features: list[float]) -> float:
        z = self.theta[0] + sum(w * x for w, x in zip(self.theta[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def seeds() -> Grammar:
    """The grammar before any learning."""
    return Grammar({w: 1.0 for w in SEEDS["insult"].split()})


def held_out(key):
    """Rows that no label may be learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """``(text, toxic, weight)`` of about ``sample`` labelled rows outside the held-out part, never over twice that.

    Copies and near copies share a weight of one: rows whose least word hash is equal
    count as one group.
    """
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    named = named.groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    few = named.where(about(sample / max(1, named.count()), F.col(key))).limit(2 * sample)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(few), key).dropDuplicates([key])
    least = F.array_min(F.transform(F.split("text", r"\s+"), lambda w: F.xxhash64(w)))
    rows = materialize(rows.select("text", "toxic", least.alias("least")))
    groups = rows.groupBy("least", "toxic").agg((1 / F.count("*")).alias("weight"))
    return rows.join(F.broadcast(groups), ["least", "toxic"]).select("text", "toxic", "weight")


def learn_patterns(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings of words that mark toxic texts, with weights in (0, 2].

    A pattern is counted by the different words of a text that have it: a text that is
    toxic holds several, others one by chance. Counts are summed in Spark; of beginnings of the
    same support only the longest is kept, and of others the shortest that marks as well.
    """

    def count(batches):
        tally: dict[tuple[str, int], list[float]] = {}  # texts, and different words in them

        def emit():
            names = list({k for k, _ in tally})
            of = lambda label, i: pa.array([tally.get((k, label), (0.0, 0.0))[i] for k in names], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), of(1, 0), of(1, 1), of(0, 1)], names=["pattern", "texts", "a", "b"])

        for batch in batches:
            for text, toxic, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight"))):
                found: Counter = Counter()
                for word in set(_LETTERS.findall(text.lower())):
                    found[word] += 1
                    found.update([word[:n] + "*" for n in PREFIXES if n < len(word)])
                for p, n in found.items():
                    one = tally.setdefault((p, int(toxic > 0)), [0.0, 0.0])
                    one[0] += weight
                    one[1] += weight * n
                if len(tally) > COUNTED:
                    yield from emit()
                    tally = {}
        yield from emit()

    totals = {r.toxic > 0: r.n for r in rows.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    toxic, clean = totals.get(True, 0.0), totals.get(False, 0.0)
    if toxic < 1:
        return {}
    counts = rows.mapInArrow(count, "pattern string, texts double, a double, b double").groupBy("pattern").agg(*[F.sum(c).alias(c) for c in ("texts", "a", "b")])
    lift = ((F.col("a") + 0.1) / (toxic + 1)) / ((F.col("b") + 0.1) / (clean + 1))
    rate = (F.col("a") + F.col("b")) / (toxic + clean)
    spread = F.sqrt(rate * (1 / toxic + 1 / max(clean, 1.0)))
    sure = F.col("a") / toxic - F.col("b") / max(clean, 1.0) >= ERRORS * spread
    # At least SUPPORT of the toxic texts hold each of them, so they are few.
    least = max(2.0, SUPPORT * toxic)
    found = {r.pattern: (r.a, r.lift) for r in counts.withColumn("lift", lift).where((F.col("texts") >= least) & (F.col("lift") >= LIFT) & sure).collect()}
    kept = {}
    for p, (a, lift) in found.items():
        stem = p.rstrip("*")
        longer = p.endswith("*") and any(
            q != p and q.startswith(stem) and (n >= 0.95 * a or n >= 0.6 * a and more > lift) for q, (n, more) in found.items()
        )
        covered = any(q != p and q.endswith("*") and stem.startswith(q[:-1]) and n > a / 0.95 and 2 * more > lift for q, (n, more) in found.items())
        if not longer and not covered:
            kept[p] = min(2.0, math.log(lift) / 4)
    return kept


def fit_weights(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton steps, held near the grammar's own weights."""
    prior = Grammar({}).theta
    theta = prior.copy()
    x = np.hstack([np.ones((len(features), 1)), features])
    scale = max(1.0, weight.sum())
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - toxic)) / scale + penalty * (theta - prior)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x / scale + penalty * np.eye(len(theta))
        theta = theta - np.linalg.solve(bend, grad)
    theta[1:] = np.maximum(theta[1:], 0.05)  # no kind of attack makes a text less toxic
    return theta


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Grammar:
    """Learn the lexicon and the weights from a bounded sample of labelled rows.

    Without labels the seeds stay as they are. Ids, labels and sources are no inputs of
    the score; held-out rows are never read here.
    """
    rows = training_rows(docs, labels, key, text, label, sample)
    grammar = Grammar({**seeds().patterns, **learn_patterns(rows)})

    def measure(batches):
        machine = Transducers(grammar)
        for batch in batches:
            found = [machine.features(t)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic"), batch.column("weight")], names=["f", "toxic", "weight"])

    got = rows.mapInArrow(measure, "f array<double>, toxic int, weight double").collect()  # the bounded sample
    if got:
        x, y, w = np.array([r.f for r in got]), np.array([float(r.toxic > 0) for r in got]), np.array([r.weight for r in got])
        if 0 < y.sum() < len(y):
            grammar.theta = fit_weights(x, y, w)
    return grammar


CLAUSES = "array<struct<start:int,end:int,kind:string,weight:double>>"


def score(df: DataFrame, grammar: Grammar, text: str = "text", into: str = "toxicity", clauses: str | None = "toxic_clauses") -> DataFrame:
    """Add the score of each whole text, and the matched clauses with what they mostly say.

    Scores lie in (0, 1); null and empty texts get the score of a text without matches.
    ``start`` and ``end`` count code points of the lower-cased text. Other columns stay;
    columns with the new names are replaced. A map over partitions.
    """
    df = df.drop(*[c for c in (into, clauses) if c and c != text])
    fields = [*df.schema.fields, T.StructField(into, T.DoubleType())]
    if clauses:
        fields.append(T.StructField(clauses, T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.DoubleType())
        ]))))
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())]))

    def run(batches):
        machine = Transducers(grammar)
        for batch in batches:
            scores, spans = [], []
            for value in batch.column(text):
                found, matched = machine.features(value.as_py())
                scores.append(machine.score(found))
                spans.append([{"start": a, "end": b, "kind": max(said, key=said.get), "weight": sum(said.values())} for a, b, said in matched] if clauses else None)
            columns = [*batch.columns, pa.array(scores, pa.float64())] + ([pa.array(spans, shape)] if clauses else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, into] + ([clauses] if clauses else []))

    return df.mapInArrow(run, T.StructType(fields))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, grammar, into="score", clauses=None)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
