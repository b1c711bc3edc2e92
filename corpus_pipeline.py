"""Corpus clean-up: stages that are written as Parquet and read again, one after the other.

Every stage works on all rows its predecessor kept, and all but the last return the columns of ``documents``:

1. language: documents without a language go (no letters, or no language that labels 40 % of the letters)
2. near copies: of each group that SimHash fingerprints of shingles of three words and links of two bits hold together, one stays
3. benchmark: documents that leak a benchmark item go
4. secrets: secrets in texts are masked, and ``n_chars`` follows; all documents stay
5. pieces: the texts as pieces of a vocabulary, with the scores of the best segmentations

Nulls, empty texts, ties, repeated rows, empty tables and further columns: see the operators' modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traffic_risk.llm import decontaminate, language, pieces, registry, secret_scan, simhash
from traffic_risk.llm.common import drop_written, written

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, registry.language_model(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, seed=42)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, registry.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.mask_secrets(docs, registry.fresh_ledger(spark))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(docs, registry.PIECES, n=4)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return docs
