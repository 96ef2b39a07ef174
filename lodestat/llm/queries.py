"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import (
    contamination,
    fingerprints,
    jaccard_join,
    language_model,
    manifest,
    near_vectors,
    oracles,
    packing,
    pieces,
    prefix_trie,
    quality,
    substring_dedup,
    suffix_dedup,
    surrogates,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of some 50 words are often shorter than the 400 bytes of the contract; ``n_repeated`` tells of them."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), shorter=200)


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(found)


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id")


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", "kept")


@query
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


@query
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"), order=3)


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.documents_manifest(table(spark, sf_dir, "documents"))
