"""Corpus pipeline over the documents table: STAGES in order, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regolith.llm import decontaminate, mixing, near_copies, secrets, toxicity
from regolith.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the toxicity grammar, learned from these documents' labels, scores 0.5 or more."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts whose five-word shingles have Jaccard similarity 0.8 or more.

    SimHash fingerprints of the shingles are linked within seven bits by BK-trees and the links verified as text. No
    radius finds all such pairs, so what the links leave apart is joined exactly (op5_simhash keeps its own contract).
    """
    return near_copies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces owner-specific live-looking credentials in the texts; all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Realises the temperature mixture: a row for each occurrence of a document, every document at least once."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned toxicity grammar and SimHash cannot be stated in SQL.
ORACLE_SQL = None
