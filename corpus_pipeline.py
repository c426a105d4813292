"""A training-data pipeline over ``documents``: five stages, each one operator of ``catalux.llm``.

Every stage takes (spark, docs, sf_dir) and gets all that the stage before it kept; its result is written as
Parquet in the shared folder and read again.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalux.llm import length_buckets, minhash, quality_classifier, quality_rules, suffix_dedup
from catalux.llm.tables import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees score 0.7 or more (labels of the table, learnt on these documents)."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return minhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes or more that occur again; n_chars follows the text."""
    return suffix_dedup.without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's padded length, batch and slot."""
    return length_buckets.packed(docs)


STAGES = [
    ("quality_classifier", quality),
    ("quality_rules", rules),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("length_packing", packing),
]

# A fitted model, MinHash groups and a dynamic programme are not expressible in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
