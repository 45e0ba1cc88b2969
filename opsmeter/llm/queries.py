"""The registered queries of the operators, with their production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opsmeter.llm import (
    audit,
    counts,
    dedup,
    embeddings,
    jaccard,
    lattice,
    mixing,
    packing,
    pieces,
    quality,
    secrets,
    sharding,
    whitening,
)
from opsmeter.llm.sql import SQL  # noqa: F401


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similarity_components(_table(spark, folder, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"), threshold=0.95)


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def packing_options() -> dict[str, str]:
    return {
        "tokenizer": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(_table(spark, folder, "documents"), limit=2048, **packing_options())


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digests(sharding.shuffled(_table(spark, folder, "documents"), shards=24))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return lattice.document_scores(_table(spark, folder, "documents"), path)


def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.secret_spans(_table(spark, folder, "documents")))


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.piece_digests(_table(spark, folder, "documents"), model)


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_groups(_table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return counts.token_counts(_table(spark, folder, "documents"), tokenizer, limit=2048)


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"), components=8)


def op12_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_table(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.filter_audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_sharding": op5_sharding,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_secret_scans": op7_secret_scans,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_mixing": op12_source_mixing,
    "op13_filter_audit": op13_filter_audit,
}
