"""Pipeline over ``documents``: rules, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before
it kept; ``run`` writes every stage's result as Parquet in the shared folder
and reads it back as the next stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trendlens.llm import bpe, dedup_index, neardup, packing, pii, quality_rules
from trendlens.llm.common import documents, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return dedup_index.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id."""
    return neardup.drop_near_duplicates(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked (and n_chars brought up to date)."""
    return pii.mask_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences."""
    return packing.pack_documents(docs, bpe.read_file(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

# The near-duplicate and packing stages have no SQL form; tests/llm hold the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
