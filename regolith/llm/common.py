"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions.tables import shared_dir, written

__all__ = ["BROADCAST_ROWS", "bound", "first_rows", "free_names", "fresh_path", "held_out", "row_key", "shared_dir", "sized", "table", "training_rows", "written"]

#: A side of at most this many narrow rows may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the counted rows are within the limit; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def bound(value: Column, body) -> Column:
    """body(value) with the value worked out once for a row, not at each use inside a lambda."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def row_key(text: str = "text"):
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def held_out():
    """True where crc32(doc_id as text) mod 5 is 0; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """A bounded sample of labelled, not held-out rows: doc_id, text, label.

    max_rows is the documented bound of the sample (exceeded by chance by a few per cent at most).
    Rows are chosen by a hash of doc_id, so the sample does not depend on partitioning; null labels
    and null ids are left out, repeated texts are taken once.
    """
    lab = (
        labels.select("doc_id", F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    total = lab.count()
    if total > max_rows:
        lab = lab.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    picked = docs.join(sized(lab, min(total, max_rows)), "doc_id")
    return picked.groupBy(F.xxhash64("text").alias("key"), F.length("text").alias("size")).agg(
        F.min(F.struct("doc_id", "label", "text")).alias("row")
    ).select("row.doc_id", "row.text", F.col("row.label").cast("int").alias("label"))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each lengthened until no column of the input has it (Spark takes no account of case)."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def first_rows(documents: DataFrame, firsts: DataFrame) -> DataFrame:
    """The documents that firsts(id, row_key) names, one row of each; a null doc_id has the largest long as id."""
    i, k = free_names(documents.columns, "id", "row_key")
    keyed = documents.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn(k, row_key())
    kept = keyed.join(firsts.select(F.col("id").alias(i), F.col("row_key").alias(k)), [i, k], "left_semi")
    return kept.dropDuplicates([i, k]).select(*documents.columns)
