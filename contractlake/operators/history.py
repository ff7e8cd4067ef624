"""Versions, histories and logs, rebuilt from append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def append_versions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The new summaries (document_id, summary_text, edited_by, created_at) with version numbers that go on after the stored ones."""
    last = stored.groupBy("document_id").agg(F.max("version_number").alias("__last"))
    turn = F.row_number().over(W.partitionBy("document_id").orderBy("created_at", "summary_text"))
    rows = new.join(last, "document_id", "left").withColumn("version_number", F.coalesce("__last", F.lit(0)) + turn).drop("__last")
    return rows.withColumn("is_ai_generated", F.col("edited_by").isNull())


def latest_versions(versions: DataFrame) -> DataFrame:
    """The last version of each document."""
    others = [c for c in versions.columns if c != "document_id"]
    return versions.groupBy("document_id").agg(F.max_by(F.struct(*others), "version_number").alias("v")).select("document_id", "v.*")


def approve_versions(versions: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions with approval_status, approvals (document_id, version_number) of versions that do not exist)."""
    keys = ["document_id", "version_number"]
    marked = versions.join(approvals.select(*keys).distinct().withColumn("__yes", F.lit(True)), keys, "left")
    marked = marked.withColumn("approval_status", F.when(F.col("__yes"), "approved").otherwise(F.col("approval_status"))).drop("__yes")
    return marked, approvals.join(versions.select(*keys), keys, "left_anti")


def restore_versions(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """New versions that copy old texts. requests: document_id, version_number, edited_by, created_at."""
    old = versions.select("document_id", "version_number", "summary_text")
    rows = requests.join(old, ["document_id", "version_number"]).withColumnRenamed("version_number", "restored_from_version")
    return append_versions(versions, rows)


def audit_trail(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Adds `sequence` (from 1) in (time, id) order within each job."""
    return events.withColumn("sequence", F.row_number().over(W.partitionBy(key).orderBy("event_time", "audit_id")))


def visible_turns(turns: DataFrame, cleared: DataFrame) -> DataFrame:
    """Chat turns (document_id, turn) after the document's clear marker (document_id, cleared_at), or all without one."""
    rows = turns.join(cleared, "document_id", "left")
    return rows.filter(F.col("cleared_at").isNull() | (F.col("turn") > F.col("cleared_at"))).drop("cleared_at")


def memory_window(turns: DataFrame, size: int = 6) -> DataFrame:
    """The last `size` answered turns of each document."""
    rank = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("turn")))
    return turns.filter("status = 'answered'").withColumn("__rank", rank).filter(F.col("__rank") <= size).drop("__rank")


def confidentiality_history(changes: DataFrame) -> DataFrame:
    """The changes (document_id, seq, source, new_level) that took effect, with the level before each.

    After a manual change automatic ones are dropped.
    """
    before = W.partitionBy("document_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    fixed = F.coalesce(F.max(F.col("source") == "manual").over(before), F.lit(False))
    kept = changes.withColumn("__fixed", fixed).filter((F.col("source") == "manual") | ~F.col("__fixed")).drop("__fixed")
    return kept.withColumn("previous_level", F.lag("new_level").over(W.partitionBy("document_id").orderBy("seq")))


def current_levels(history: DataFrame) -> DataFrame:
    return history.groupBy("document_id").agg(F.max_by("new_level", "seq").alias("level"), F.max_by("source", "seq").alias("source"))


def review_history(actions: DataFrame) -> DataFrame:
    """Review actions in time order within each document."""
    return actions.withColumn("sequence", F.row_number().over(W.partitionBy("document_id").orderBy("event_time", "review_action_id")))


def action_counts(actions: DataFrame, kinds: list[str]) -> DataFrame:
    """Actions by reviewer, one column a kind."""
    return actions.groupBy("reviewer").pivot("action", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)
