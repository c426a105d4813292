"""Queries of the training-data operators, each over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalux.llm import (length_buckets, lm_scoring, minhash, oracles, quality_classifier, quality_rules, scaled_sketch,
                         sentencepieces, source_audit, source_mix, suffix_dedup, token_files,
                         vector_codes, warc)
from catalux.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return put


@query("op10_boosted_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model)


@query("op1_scaled_sketch")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprints(table(spark, sf_dir, "documents"))


@query("op2_circulant_minhash", oracles.OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("text_hash", "k1", "k2")


@query("op3_rule_cascade", oracles.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query("op6_indexed_warc", oracles.OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query("op7_length_buckets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.packed(table(spark, sf_dir, "documents"))


@query("op9_bucket_pointer_dedup", oracles.OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_elias_fano_tokens")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op5_backoff_automaton")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


@query("op8_piece_lattice")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op11_chunk_audit", oracles.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(table(spark, sf_dir, "documents"))


@query("op13_entropy_balance")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed(table(spark, sf_dir, "documents"))


@query("op12_ball_codes", oracles.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))
