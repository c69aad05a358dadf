"""Quality rules as a ledger of failure bits, in built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafquire.llm.shared import SPACE, fresh, let, table, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Rule name and the SQL condition under which a document fails it, over the measurements.
#: A rule's place in the list is its bit in the ledger; new rules go to the end.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("capitals", "100 * n_capitals > 60 * word_chars"),
    ("stutter", "100 * n_same_as_previous > 30 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("long_words", "word_chars > 30 * n_words"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (name, _) in enumerate(RULES) if name in self.rules)


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", tuple(name for name, _ in RULES)),
}


def _repeat_words(tokens: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    A window's fingerprint is a 64-bit hash of its words' hashes. Texts without equal
    fingerprints, the common case, stop after one pass. In the others the fingerprints
    are sorted with their places; a window equal to a neighbour in that order repeats,
    and the places of such windows, sorted, give the words covered. That is n log n at
    worst, within one row and without a shuffle.
    """

    def windows(h: Column) -> Column:
        parts = lambda i: [F.get(h, i + k) for k in range(window)]
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*parts(i)))

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(window)), F.lit(window))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def repeats(prints: Column) -> Column:
        placed = F.array_sort(F.transform(prints, lambda f, i: F.struct(f.alias("f"), i.alias("i"))))
        again = lambda s: F.filter(
            F.transform(
                s,
                lambda x, k: F.when(
                    (F.get(s, k - 1)["f"] == x["f"]) | (F.get(s, k + 1)["f"] == x["f"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(let(placed, again), lambda found: let(F.array_sort(found), covered))

    def check(prints: Column) -> Column:
        return F.when(F.size(F.array_distinct(prints)) == F.size(prints), F.lit(0).cast("long")).otherwise(repeats(prints))

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) <= window, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), check)))


def measurements(text: Column, window: int = WINDOW) -> Column:
    """All measurements of a text as one struct; the text is split into words once."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        same = F.aggregate(
            F.transform(w, lambda x, i: F.when(F.get(w, i - 1) == x, 1).otherwise(0)),
            F.lit(0).cast("long"), lambda total, x: total + x,
        )
        return F.struct(F.size(w).cast("long").alias("n"), same.alias("same"), _repeat_words(w, window).alias("repeat"))

    from_words = let(words(text), of_words)
    from_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    length = F.length(body)
    return F.struct(
        from_words.alias("w"), from_lines.alias("l"),
        F.length(F.translate(body, " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (length - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
    )


def ledger(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add each measurement and ``failure_bits``: bit ``i`` is set if rule ``i`` fails.

    Every rule is evaluated once; policies and ablations read the bits alone. Null
    and empty texts measure 0 everywhere, so they fail ``few_words``. Other columns stay;
    columns with a measurement's name are replaced. One map over the rows, no shuffle.
    """
    (m,) = fresh(df, "_measured")
    out = df.withColumn(m, measurements(F.col(text), window))
    for name, path in (
        ("n_words", "w.n"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "l.dup"),
        ("n_repeat_words", "w.repeat"), ("n_lines", "l.n"), ("n_capitals", "n_capitals"), ("n_same_as_previous", "w.same"),
    ):
        out = out.withColumn(name, F.col(f"{m}.{path}"))
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("failure_bits", bits).drop(m)


def apply_policy(ledgered: DataFrame, policy: Policy, into: str = "kept") -> DataFrame:
    """Add whether a document passes all rules of the policy."""
    return ledgered.withColumn(into, F.col("failure_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(ledgered: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it rejects, and kept without it."""
    bits = F.col("failure_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    rules = [(i, name) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1]
    counts = ledgered.agg(
        F.count_if(bits == 0).alias("kept"),
        *[F.count_if(bits.bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias(f"f{i}") for i, _ in rules],
        *[F.count_if(bits == (1 << i)).alias(f"o{i}") for i, _ in rules],
    )
    rows = [
        F.struct(F.lit(policy.version).alias("policy"), F.lit(name).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only_here"), (F.col("kept") + F.col(f"o{i}")).alias("n_kept_without"))
        for i, name in rules
    ]
    return counts.select(F.inline(F.array(*rows)))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), POLICIES["v1"])
    base = F.col("failure_bits").bitwiseAND(F.lit(POLICIES["base"].mask).cast("long")) != 0
    return docs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failure_bits",
    )
