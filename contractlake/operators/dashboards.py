"""Dashboards: counts, trends, detail views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows by value; null is left out."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))


def flags_by_level(flags: DataFrame, *, rollup: bool = False) -> DataFrame:
    """Risk flags by severity; with `rollup` also by severity and category, and in all."""
    if rollup:
        return flags.rollup("severity", "category").agg(F.count(F.lit(1)).alias("n"))
    return count_by(flags, "severity")


def totals(missing: DataFrame, conflicts: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row: missing-clause flags, conflicting pairs, contracts."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(missing, "missing_clauses").crossJoin(one(conflicts, "conflict_pairs")).crossJoin(one(contracts, "contracts"))  # one row each


def latest_job_status(events: DataFrame) -> DataFrame:
    """Jobs by the action of their latest event (job_id, event_time, audit_id, action)."""
    last = events.groupBy("job_id").agg(F.max_by("action", F.struct("event_time", "audit_id")).alias("status"))
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"))


def run_trend(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs (run_id, started_at) first."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def latest_run(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """The cases of the newest run."""
    last = runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return cases.join(F.broadcast(last), "run_id")  # one row


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Means of clause_recall (null left out), risk_precision and missing_match."""
    return results.agg(
        F.avg("clause_recall").alias("mean_recall"), F.avg("risk_precision").alias("mean_precision"),
        F.avg(F.col("missing_match").cast("double")).alias("missing_accuracy"),
    )


def document_detail(documents: DataFrame, clauses: DataFrame, flags: DataFrame, histories: dict[str, DataFrame] | None = None) -> DataFrame:
    """Documents with nested clauses, each with its flags, and document-level flags; grouped bottom up, joined once a level.

    Keys: contract_id, clause_id; `histories` are further children by contract_id.
    """
    flag = F.struct("category", "severity", "confidence")
    by_clause = flags.filter("clause_id is not null").groupBy("contract_id", "clause_id").agg(F.array_sort(F.collect_list(flag)).alias("flags"))
    nested = clauses.join(by_clause, ["contract_id", "clause_id"], "left")
    each = F.struct("clause_id", "clause_type", "text", "flags")
    out = documents.join(nested.groupBy("contract_id").agg(F.array_sort(F.collect_list(each)).alias("clauses")), "contract_id", "left")
    own = flags.filter("clause_id is null").groupBy("contract_id").agg(F.array_sort(F.collect_list(flag)).alias("document_flags"))
    out = out.join(own, "contract_id", "left")
    for name, rows in (histories or {}).items():
        fields = [c for c in rows.columns if c != "contract_id"]
        out = out.join(rows.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)), "contract_id", "left")
    return out


def listing(rows: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """A projection of a table, filtered."""
    return (rows.filter(where) if where else rows).select(*columns)
