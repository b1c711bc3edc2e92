"""One query per operator with its production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traffic_risk.llm import (
    clustering,
    decontaminate,
    hard_negatives,
    language,
    main_text,
    ngram_lm,
    pieces,
    pii,
    quality,
    secret_scan,
    simhash,
    spans,
    substring_dedup,
    toxicity,
    vector_sql,
)
from traffic_risk.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, seed=42)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def fresh_ledger(spark: SparkSession) -> secret_scan.BlobLedger:
    return secret_scan.BlobLedger(spark, scratch_dir(spark, "ledger"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, fresh_ledger(spark))
    return found.select(
        "doc_id",
        *[spans.count("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        spans.digest("spans").alias("base_sha256"),
        spans.text_of("spans").alias("spans"),
    )


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count("spans", k).alias(f"n_{k}") for k in pii.KINDS],
        spans.digest("spans").alias("base_sha256"),
        spans.text_of("spans").alias("spans"),
    )


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rated = quality.rate_quality(table(spark, sf_dir, "documents"), trusted)
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score",
    )


def language_model(docs: DataFrame) -> language.LanguageModel:
    """Learned from the documents that are not held out: CRC-32 of the id, modulo 4, is not 2."""
    return language.fit(docs.where(~language.held_out("doc_id", 4, 2)), "text", "lang")


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out("doc_id", 4, 2).alias("held_out")
    keys = "doc_id bigint, held_out boolean"
    return language.identify(docs, language_model(docs), ["doc_id", held], keys)


PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
"""Vocabulary file on the driver."""


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), PIECES, n=4)


@query
def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_lm.score_texts(docs, language.held_out("doc_id", 7, 2))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    repeated = (F.col("n_removed") > 0).alias("repeated")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", repeated)


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.main_texts(pages, main_text.fit(pages, "html"))


@query
def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(table(spark, sf_dir, "embeddings"))
    digest = clustering.centroid_digest("centroid").alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


CHECKS["op11_clusters"] = vector_sql.clusters()


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score_toxicity(docs, model, ["doc_id", held.alias("held_out")], "doc_id bigint, held_out boolean")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id gets the next label, which gives the anchors rows of a wrong label among the near ones."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


CHECKS["op13_hard_negatives"] = vector_sql.hard_negatives()
