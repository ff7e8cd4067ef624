"""Content hashes, upserts and merges by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_clauses(arrivals: DataFrame) -> DataFrame:
    """One row per (document_id, content_hash): the first arrival's id, the last one's page and confidence, a version for each arrival.

    arrivals: document_id, content_hash, clause_id, page_reference, confidence, seq.
    """
    return arrivals.groupBy("document_id", "content_hash").agg(
        F.min_by("clause_id", "seq").alias("clause_id"),
        F.max_by("page_reference", "seq").alias("page_reference"),
        F.max_by("confidence", "seq").alias("confidence"),
        F.count(F.lit(1)).alias("version"),
    )


def merge_clauses(stored: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The stored clauses after a batch of arrivals: ids stay, pages and confidences follow, versions add up."""
    new = upsert_clauses(arrivals).select(
        "document_id", "content_hash", *[F.col(c).alias(f"new_{c}") for c in ("clause_id", "page_reference", "confidence", "version")]
    )
    both = stored.join(new, ["document_id", "content_hash"], "full_outer")
    return both.select(
        "document_id", "content_hash", F.coalesce("clause_id", "new_clause_id").alias("clause_id"),
        F.coalesce("new_page_reference", "page_reference").alias("page_reference"),
        F.coalesce("new_confidence", "confidence").alias("confidence"),
        (F.coalesce("version", F.lit(0)) + F.coalesce("new_version", F.lit(0))).alias("version"),
    )


def merge_nodes(loads: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: in each column the last value that is not null."""
    others = [c for c in loads.columns if c not in (key, order)]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others]
    return loads.groupBy(key).agg(*last)
