"""Scores and routes of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlake.functions import columns as C
from contractlake.functions import rules


def deviation(rows: DataFrame) -> DataFrame:
    """Adds similarity, deviation and confidence of clause_vector against approved_vector; null without an approved text."""
    s = F.when(F.col("approved_vector").isNotNull(), C.cosine(F.col("clause_vector"), F.col("approved_vector")))
    out = rows.withColumn("__s", s)
    return out.withColumns({
        "similarity": F.round("__s", 4), "deviation": F.round(1 - F.col("__s"), 4),
        "confidence": F.round(1 - 4 * F.col("__s") * (1 - F.col("__s")), 3),
    }).drop("__s")


def composite_confidence(weights: dict[str, float] = rules.CONFIDENCE_WEIGHTS) -> Column:
    """Weighted mean of the components that are not null, their weights made to sum to 1; null if all are."""
    total = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), F.lit(w) * F.col(k)).otherwise(0.0) for k, w in weights.items()])
    weight = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()])
    return F.round(F.try_divide(total, weight), 3)


def weakest_component(labels: dict[str, str] = rules.CONFIDENCE_LABELS) -> Column:
    """Label of the least component; ties go to the one declared first."""
    each = [F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("v"), F.lit(i).alias("i"), F.lit(label).alias("label"))) for i, (k, label) in enumerate(labels.items())]
    return F.array_min(F.array_compact(F.array(*each)))


def low_confidence_reason(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds composite and reason: the weakest component where the composite is below the threshold."""
    out = rows.withColumn("composite", composite_confidence()).withColumn("__w", weakest_component())
    percent = F.concat(F.round(F.col("__w.v") * 100, 0).cast("int").cast("string"), F.lit("%"))
    reason = F.concat(F.lit("low confidence: "), F.col("__w.label"), F.lit(" "), percent)
    return out.withColumn("reason", F.when(F.col("composite") < threshold, reason)).drop("__w")


def assigned_role(severity: Column, confidence: Column, bar: Column | None = None, floor: Column | None = None, *, at_or_above: bool = False) -> Column:
    """senior_counsel at the org's severity bar, or at medium and high below its confidence floor; else reviewer."""
    bar = F.coalesce(bar, F.lit("high")) if bar is not None else F.lit("high")
    floor = F.coalesce(floor, F.lit(0.6)) if floor is not None else F.lit(0.6)
    rank = lambda c: C.rank_of(c, {"low": 0, "medium": 1, "high": 2})
    reached = rank(severity) >= rank(bar) if at_or_above else severity == bar
    unsure = severity.isin("medium", "high") & (confidence < floor)
    return F.when(F.coalesce(reached, F.lit(False)) | F.coalesce(unsure, F.lit(False)), "senior_counsel").otherwise("reviewer")


FINDING = ["contract_id", "clause_id", "category", "severity", "confidence", "action", "rule_source"]


def finding(rows: DataFrame, category: str, severity: str, *, confidence: float = 1.0, action: str = "review", source: str = "deterministic", clause: bool = True) -> DataFrame:
    """Rows of one rule in the shape of the risk table; without a clause the finding is the document's."""
    return rows.select(
        "contract_id", (F.col("clause_id") if clause else F.lit(None)).cast("string").alias("clause_id"), F.lit(category).alias("category"),
        F.lit(severity).alias("severity"), F.lit(float(confidence)).alias("confidence"), F.lit(action).alias("action"), F.lit(source).alias("rule_source"),
    )


def risk_table(findings: list[DataFrame], overrides: DataFrame | None = None) -> DataFrame:
    """One table of all findings, each with the role it goes to. overrides: contract_id, severity_bar, confidence_floor."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), findings)
    bar = floor = None
    if overrides is not None:
        rows, bar, floor = rows.join(overrides, "contract_id", "left"), F.col("severity_bar"), F.col("confidence_floor")
    return rows.withColumn("assigned_role", assigned_role(F.col("severity"), F.col("confidence"), bar, floor)).drop("severity_bar", "confidence_floor")
