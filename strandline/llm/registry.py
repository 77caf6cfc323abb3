"""The training-data queries by name: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import ann_search, byte_bpe, chat_format, decontaminate, fill_in_middle, jaccard_join, language_id, license_scan, merkle_manifest, quality_cnn, secret_scan, sharding, suffix_dedup
from strandline.runtime import ship_package, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.probe_conversation(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_turns(turns, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.cluster(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    ship_package(spark)
    return secret_scan.scan(documents, secret_scan.train(documents, "text", "doc_id"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_search.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_chat_format, op2_quality_cnn, op3_jaccard_join, op4_license_scan, op5_secret_scan, op6_suffix_dedup, op7_language_id, op8_byte_bpe, op9_ann_search,
    op10_decontaminate, op11_merkle_manifest, op12_fill_in_middle, op13_hilbert_shards,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.ORACLE,
        "op10_decontaminate": decontaminate.ORACLE,
        "op11_merkle_manifest": merkle_manifest.ORACLE,
        "op12_fill_in_middle": fill_in_middle.ORACLE,
        "op13_hilbert_shards": sharding.ORACLE,
    }
