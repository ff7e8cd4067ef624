"""Conflicts across a portfolio: durations of one kind of clause that disagree between contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlake.functions import columns as C

LEAST_DAYS = 15
#: Clauses that one task of `term_spread` is meant for.
PER_TASK = 250_000


def with_term(clauses: DataFrame) -> DataFrame:
    """Adds `days`: the longest duration a clause names; null if it names none."""
    return clauses.withColumn("days", F.array_max(C.duration_days(F.col("text"))))


def named_terms(clauses: DataFrame) -> DataFrame:
    """The clauses that name a duration, with `days`.

    One match test comes first; `days` is never null then, so that no test of it is pushed below the extraction and repeats it.
    """
    return clauses.filter(F.col("text").rlike(C.DURATION)).withColumn("days", F.coalesce(F.array_max(C.duration_days(F.col("text"))), F.lit(0)))


def conflicting_pairs(clauses: DataFrame, *, scope: str, least_days: int = LEAST_DAYS) -> DataFrame:
    """Pairs of clauses of one scope and type, of different contracts, whose longest durations differ by at least `least_days`.

    clauses: scope column, contract_id, clause_id, clause_type, text. An equi-join on scope and
    type; clauses without a duration are dropped before it.
    """
    terms = named_terms(clauses).select(scope, "clause_type", "contract_id", "clause_id", "days")
    a, b = terms.alias("a"), terms.alias("b")
    same = (F.col(f"a.{scope}") == F.col(f"b.{scope}")) & (F.col("a.clause_type") == F.col("b.clause_type"))
    apart = (F.col("a.contract_id") != F.col("b.contract_id")) & (F.col("a.clause_id") < F.col("b.clause_id"))
    pairs = a.join(b, same & apart & (F.abs(F.col("a.days") - F.col("b.days")) >= least_days))
    return pairs.select(
        F.col(f"a.{scope}").alias(scope), F.col("a.clause_type").alias("clause_type"),
        F.col("a.contract_id").alias("contract_a"), F.col("a.clause_id").alias("clause_a"), F.col("a.days").alias("days_a"),
        F.col("b.contract_id").alias("contract_b"), F.col("b.clause_id").alias("clause_b"), F.col("b.days").alias("days_b"),
        F.abs(F.col("a.days") - F.col("b.days")).alias("delta_days"),
    )


def scopes_of_several(contracts: DataFrame, scope: list[str], least: int = 2) -> DataFrame:
    """The contracts of scopes that hold at least `least` of them."""
    large = contracts.groupBy(*scope).agg(F.count_distinct("contract_id").alias("n")).filter(F.col("n") >= least)
    return contracts.join(large.select(*scope), scope, "left_semi")


def term_spread(clauses: DataFrame, *, scope: str, contracts: DataFrame | None = None) -> DataFrame:
    """Least and greatest duration, their spread and the number of contracts of each scope and type: linear where pairs are not.

    `contracts` (contract_id, scope): where the clauses do not hold their scope. Durations are taken before anything is dealt; clauses are then dealt by
    contract into tasks of about `PER_TASK`, whose number grows with the table, and each contract is one row of its scope and type after that.
    """
    parts = max(1, -(-clauses.count() // PER_TASK))
    terms = named_terms(clauses).select(*([] if contracts is not None else [scope]), "contract_id", "clause_type", "days").repartition(parts, "contract_id")
    if contracts is not None:
        terms = terms.join(contracts.select("contract_id", scope).repartition(parts, "contract_id"), "contract_id")
    each = terms.groupBy(scope, "clause_type", "contract_id").agg(F.min("days").alias("low"), F.max("days").alias("high"))
    return each.groupBy(scope, "clause_type").agg(
        F.min("low").alias("min_days"), F.max("high").alias("max_days"), (F.max("high") - F.min("low")).alias("spread_days"),
        F.count("contract_id").alias("n_contracts"),
    )
