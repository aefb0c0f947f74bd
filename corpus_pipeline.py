"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, mixture.

Each stage reads what the one before it wrote and returns the columns of documents, extra ones too; the last adds size, source_size, target and
taken, replacing columns of these names. Null, empty and blank texts go in the first stage (they have no words); null ids and sources stay, nulls
last in every order; repeated rows are near copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.llm import decontaminate, mixing, paragraphs, quality, simhash
from histomesh.llm.common import live, sweep, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.cascade(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard 0.8 or more."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat an earlier one."""
    return paragraphs.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its size, its source's size and target, and the words that the mix takes of it."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: MinHash, the order of removals and the knapsack aren't SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has left in the shared folder is taken away as soon as its result is written there."""
    docs, before = table(spark, sf_dir, "documents"), live()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, [x for x in live() if x not in before and x != docs.written_path])
    return docs
