"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import (bpe, dedup_index, embedding_join, langid, licenses, neardup, packing, pii, quality_crf,
               quality_rules, ranked_search, sharding, spelling)
from .common import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), 16)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = neardup.link_documents(documents(spark, sf_dir))
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), bpe.read_file(public_tokenizers.path("byte_bpe_50k.json")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_crf.score_documents(docs, quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_index.index_duplicates(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


def op12_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_language_id": op2_language_id,
        "op3_jump_sharding": op3_jump_sharding,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_packing": op5_packing,
        "op6_license_scan": op6_license_scan,
        "op7_quality_crf": op7_quality_crf,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_personal_data": op9_personal_data,
        "op10_quality_rules": op10_quality_rules,
        "op11_ranked_search": op11_ranked_search,
        "op12_embedding_join": op12_embedding_join,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_duplicates": neardup.SQL,
        "op6_license_scan": licenses.SQL,
        "op8_exact_dedup": dedup_index.SQL,
        "op10_quality_rules": quality_rules.SQL,
        "op11_ranked_search": ranked_search.SQL,
        "op12_embedding_join": embedding_join.SQL,
        "op13_spelling_variants": spelling.SQL,
    }
