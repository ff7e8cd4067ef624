"""Metadata in one shape: parties, dates, model responses, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.functions import columns as C
from contractlake.functions import rules

PARTIES = "array<struct<name:string,role:string>>"


def flat_metadata(contracts: DataFrame) -> DataFrame:
    """Parties joined, country upper-cased, missing text '' and missing value 0."""
    return contracts.select(
        "contract_id",
        F.coalesce(F.array_join("parties", ", "), F.lit("")).alias("parties"),
        F.upper(F.coalesce("governing_law_country", F.lit(""))).alias("governing_law_country"),
        F.coalesce("contract_type", F.lit("")).alias("contract_type"),
        F.coalesce("monetary_value", F.lit(0.0)).alias("monetary_value"),
        F.coalesce(C.epoch(F.col("effective_date")), F.lit(0)).alias("effective_epoch"),
    )


def counterparty(parties: Column, vendor_name: Column) -> Column:
    """A given vendor; else the first party with a supplier's role; else the only name; else all names."""
    named = F.filter(
        F.transform(F.coalesce(parties, F.array().cast(PARTIES)), lambda p: F.struct(C.strip(p["name"]).alias("name"), F.lower(C.strip(p["role"])).alias("role"))),
        lambda p: F.coalesce(p["name"], F.lit("")) != "",
    )
    supplier = F.filter(named, lambda p: C.any_of(F.coalesce(p["role"], F.lit("")), rules.SUPPLIER_ROLES))
    given = C.strip(vendor_name)
    names = F.array_join(F.transform(named, lambda p: p["name"]), " / ")
    found = F.coalesce(F.when(given != "", given), F.try_element_at(supplier, F.lit(1))["name"], F.when(F.size(named) > 0, names))
    return F.substring(found, 1, 200)


def parsed_response(raw: Column, schema: str) -> Column:
    """A model's JSON answer, code fences off, in the declared schema; null where it has another shape."""
    body = F.regexp_replace(C.strip(raw), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")
    return F.from_json(body, schema, {"mode": "PERMISSIVE"})


def parse_responses(rows: DataFrame, raw: str, schema: str) -> DataFrame:
    """Adds `parsed`, and `quarantine` with the raw text where it could not be parsed."""
    parsed = parsed_response(F.col(raw), schema)
    empty = parsed.isNull() | F.to_json(parsed).eqNullSafe("{}")
    return rows.withColumn("parsed", F.when(~empty, parsed)).withColumn("quarantine", F.when(empty & F.col(raw).isNotNull(), F.col(raw)))


def safe_choice(value: Column, allowed: list[str], default: str) -> Column:
    """The value if it is allowed, else the default."""
    return F.when(value.isin(allowed), value).otherwise(default)


CLAUSES = "array<struct<clause_type:string,text:string,parties_mentioned:array<string>,confidence:double>>"


def explode_clauses(chunks: DataFrame, raw: str = "response") -> DataFrame:
    """A row for each clause that the annotation of a chunk names; the first party mentioned is its party."""
    found = F.explode(F.coalesce(parsed_response(F.col(raw), CLAUSES), F.array().cast(CLAUSES)))
    rows = chunks.select("chunk_id", "document", "page_start", "page_end", "section", found.alias("c"))
    return rows.select(
        "chunk_id", "document", "page_start", "page_end", "section", "c.clause_type", "c.text",
        F.try_element_at("c.parties_mentioned", F.lit(1)).alias("party"), "c.confidence",
    )


def party_rows(contracts: DataFrame) -> DataFrame:
    """A row for each party; plain names have no role."""
    plain = F.transform("parties", lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("role")))
    each = F.explode(F.coalesce(F.col("parties_with_roles"), plain))
    return contracts.select("contract_id", each.alias("p")).select("contract_id", "p.name", "p.role")


def resolve_dimension(rows: DataFrame, dimension: DataFrame, *, text: str, scope: list[str], key: str) -> DataFrame:
    """Adds `key`: the id of the dimension row (id, name, code, scope columns) whose name or code is the free text; the least id wins.

    Name and code become two rows of one key column, so this is an equi-join.
    """
    either = F.explode(F.array_distinct(F.array(F.lower(C.strip(F.col("name"))), F.lower(C.strip(F.col("code"))))))
    keys = dimension.select("id", *scope, either.alias("match_key")).groupBy(*scope, "match_key").agg(F.min("id").alias(key))
    asked = rows.withColumn("match_key", F.lower(C.strip(F.col(text))))
    return asked.join(keys, [*scope, "match_key"], "left").drop("match_key")


def latest_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__turn", turn).filter("__turn = 1").drop("__turn")
