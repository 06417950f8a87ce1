"""From raw documents to packed sequences: each stage works on all rows that the one before kept.

Null texts count as empty; null or repeated ids are rows like others; texts of any length are taken whole; an empty table stays
empty; columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catchment.llm import exact_dedup, packing, pii, quality, similar_dedup
from catchment.llm.common import documents, staged


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that chains of a Jaccard similarity of 0.8 or more over shingles of five words link: that with the smallest doc_id.

    Candidates are SimHash fingerprints of sampled shingles that meet at anchors of a covering code; see similar_dedup.
    """
    return similar_dedup.drop_similar(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pii.replace_entities(docs, pii.secret_key(spark)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_exact_copies),
    ("SimHash near-dedup", without_near_copies),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier, the fingerprints and the packing; tests hold the stages against brute force and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
