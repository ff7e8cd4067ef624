"""Rule-based checks of clauses and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlake.functions import rules


def _type() -> Column:
    return F.lower(F.trim("clause_type"))


def duplicate_types(clauses: DataFrame, exempt: list[str] = rules.REPEATABLE_TYPES) -> DataFrame:
    """contract_id, clause_type, clause_ids, n of types that occur more than once in a document."""
    typed = clauses.select("contract_id", "clause_id", _type().alias("clause_type")).filter((F.col("clause_type") != "") & ~F.col("clause_type").isin(exempt))
    grouped = typed.groupBy("contract_id", "clause_type").agg(F.array_sort(F.collect_list("clause_id")).alias("clause_ids"), F.count(F.lit(1)).alias("n"))
    return grouped.filter("n > 1")


def auto_renewal(clauses: DataFrame, pattern: str = rules.AUTO_RENEWAL) -> DataFrame:
    """Clauses that renew by themselves, with the words that say so."""
    return clauses.withColumn("evidence", F.regexp_extract(F.coalesce("text", F.lit("")), pattern, 0)).filter("evidence <> ''")


def unlimited_liability(clauses: DataFrame, pattern: str = rules.UNLIMITED_LIABILITY, types: list[str] = rules.LIABILITY_TYPES) -> DataFrame:
    """Liability clauses without a limit, with the words that say so."""
    return clauses.filter(_type().isin(types)).withColumn("evidence", F.regexp_extract(F.coalesce("text", F.lit("")), pattern, 0)).filter("evidence <> ''")


def over_value(contracts: DataFrame, threshold: float | Column = rules.VALUE_THRESHOLD) -> DataFrame:
    """Contracts whose value reaches the threshold."""
    bar = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return contracts.filter(F.col("monetary_value") >= bar).withColumn("threshold", bar)


def governing_law(contracts: DataFrame, expected: DataFrame) -> DataFrame:
    """Contracts whose law is not the one expected of their org profile (org_profile_id, override_country, default_country)."""
    rows = contracts.join(expected, "org_profile_id").withColumn("expected_country", F.coalesce("override_country", "default_country"))
    tidy = lambda c: F.upper(F.trim(c))
    known = (tidy("governing_law_country") != "") & (tidy("expected_country") != "")
    return rows.filter(known & (tidy("governing_law_country") != tidy("expected_country")))


def checklist(contract_type: Column, org_checklist: Column | None = None) -> Column:
    """Clause types expected of a contract type: the org's for the type, its default, else the built-in list."""
    built_in = F.create_map(*[x for k, v in rules.EXPECTED_CLAUSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    default = F.array(*map(F.lit, rules.DEFAULT_EXPECTED))
    kind = F.lower(F.trim(F.coalesce(contract_type, F.lit(""))))
    own = F.coalesce(F.try_element_at(built_in, kind), default)
    if org_checklist is None:
        return own
    return F.coalesce(F.try_element_at(org_checklist, contract_type), F.try_element_at(org_checklist, F.lit("default")), default)


def missing_clauses(contracts: DataFrame, clauses: DataFrame, org_checklists: DataFrame | None = None) -> DataFrame:
    """contract_id, clause_type of expected types that a contract lacks; both compared in lower case."""
    rows = contracts.select("contract_id", "document_type", *(["org_profile_id"] if org_checklists is not None else []))
    own = None
    if org_checklists is not None:
        rows, own = rows.join(org_checklists.select("org_profile_id", "checklist"), "org_profile_id", "left"), F.col("checklist")
    wanted = rows.select("contract_id", F.explode(F.transform(checklist(F.col("document_type"), own), F.lower)).alias("clause_type"))
    present = clauses.select("contract_id", F.lower("clause_type").alias("clause_type"))
    return wanted.join(present, ["contract_id", "clause_type"], "left_anti")


def mandatory_gaps(required: DataFrame, clauses: DataFrame) -> DataFrame:
    """Required rows (contract_id, clause_type, ...) of whose type the contract has no clause."""
    return required.join(clauses.select("contract_id", "clause_type"), ["contract_id", "clause_type"], "left_anti")


def prohibited_present(prohibited: DataFrame, clauses: DataFrame) -> DataFrame:
    """Prohibited rows of whose type the contract has a clause, with the first such clause."""
    first = clauses.groupBy("contract_id", "clause_type").agg(F.min("clause_id").alias("clause_id"))
    return prohibited.join(first, ["contract_id", "clause_type"])


def ungrounded_figures(sections: DataFrame, *, least_length: int = 4, tolerance: float = 1.0) -> DataFrame:
    """brief_id, figure: figures of at least `least_length` characters that differ from the known value. sections: brief_id, text, monetary_value."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"[0-9,]+(?:\.[0-9]+)?"), F.lit(0)))
    rows = sections.select("brief_id", "monetary_value", found.alias("figure"))
    digits = F.replace("figure", F.lit(","), F.lit(""))
    amount = F.expr("try_cast(replace(figure, ',', '') as double)")
    wrong = F.col("monetary_value").isNull() | (F.abs(amount - F.col("monetary_value")) > tolerance)
    return rows.filter((F.length(digits) >= least_length) & amount.isNotNull() & wrong).select("brief_id", "figure")


