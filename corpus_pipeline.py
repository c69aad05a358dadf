"""A training corpus from ``documents``, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is what the stage before
kept, and returns a DataFrame; all but the last return the columns of ``documents``.
Null texts fail the first stage; rows with a null ``doc_id`` are never linked or
labelled and stay as long as their text passes; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquire.llm import bpe, minhash, mixing, quality, toxicity
from leafquire.llm.shared import fresh, materialize, table

#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the current policy."""
    judged = quality.apply_policy(quality.ledger(docs), quality.POLICIES["v1"])
    return judged.where("kept").select(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the grammar is learned from this stage's labelled rows."""
    (score,) = fresh(docs, "toxicity")
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, grammar, into=score, clauses=None)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more.

    Five words are the rule for stages; the query ``op2_minhash`` has a contract with four.
    Rows without an id or without words stay; rows that share an id are judged each by
    its own text, and of those that also share the text one stays.
    """
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole.

    A null source is a source. Texts without words are taken 0 times. Rows with equal
    sampling keys are ordered by size, then id. An empty table stays empty.
    """
    return mixing.repeat(mixing.mix(docs, split=False)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their count, in place of its text.

    A null or empty text has no ids and the count 0. Repeated rows are encoded each; an
    empty table stays empty. A column of ``docs`` named like a new one keeps its name.
    """
    ids, n = fresh(docs, "ids", "n_tokens")
    return bpe.encode(docs, ids=ids, keep_text=False).withColumn(n, F.size(ids).cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("near duplicates", without_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
