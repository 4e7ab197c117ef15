"""The registered queries of this package, each over the whole table of documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    centroids,
    conversations,
    exact_dedup,
    language,
    license_scan,
    line_dedup,
    mixing,
    quality,
    sharding,
    simhash,
    substring_dedup,
    suffix_tables,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def exact(docs: DataFrame) -> DataFrame:
    return exact_dedup.dedup_exact(docs)


def encoded(docs: DataFrame) -> DataFrame:
    return bpe.digest(docs, VOCABULARY, PATTERN)


def _over(table: str, digest: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: digest(spark.read.parquet(f"{folder}/{table}.parquet"))


QUERIES = {name: _over("documents", digest) for name, digest in {
    "op1_line_dedup": line_dedup.digest,
    "op2_exact_dedup": exact,
    "op3_mixing": mixing.digest,
    "op4_byte_bpe": encoded,
    "op5_language_id": language.digest,
    "op6_quality_rules": quality.digest,
    "op7_sharding": sharding.digest,
    "op8_substring_dedup": substring_dedup.digest,
    "op9_simhash": simhash.digest,
    "op10_license_scan": license_scan.digest,
    "op11_lm_scoring": suffix_tables.digest,
}.items()} | {
    "op12_centroid_clustering": _over("embeddings", centroids.digest),
    "op13_conversation_repair": _over("conversations", conversations.digest),
}

# Where SQL cannot say it (the cube method, BPE, a trained model, XXH64, CRC-32), tests
# compare with brute force instead.
SQL = {
    "op1_line_dedup": line_dedup.oracle_sql(),
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op7_sharding": sharding.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op10_license_scan": license_scan.ORACLE_SQL,
    "op12_centroid_clustering": centroids.oracle_sql(),
}
