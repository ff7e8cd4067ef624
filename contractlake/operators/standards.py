"""Which standard applies: candidates, activity, precedence, conflicts, fallbacks.

References and contexts meet in an equi-join on the scopes that a reference sets: the wildcard-mask index of `candidates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.functions import rules

SCOPES = ["customer_id", "org_profile_id", "business_unit_id", "jurisdiction_id"]
FIELDS = [*SCOPES, "document_type"]


def _mask(scopes: list[Column]) -> Column:
    """A number whose bits say which scopes are set."""
    out = F.lit(0)
    for k, c in enumerate(scopes):
        out = out + F.when(c.isNotNull(), 1 << k).otherwise(0)
    return out


def _keys(scopes: list[Column], mask: Column) -> list[Column]:
    """Values of the scopes in the mask as text; others are empty."""
    return [F.when((F.shiftright(mask, k) % 2) == 1, c.cast("string")).otherwise("").alias(f"_k{k}") for k, c in enumerate(scopes)]


def _sides(contexts: DataFrame, library: DataFrame, by_type: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Contexts by each mask they ask with, references by their mask, and the names of the columns in which they meet."""
    own = [F.col(f) for f in FIELDS]
    r = library.withColumn("_mask", _mask(own))
    masks = sorted(x["_mask"] for x in r.select("_mask").distinct().collect())  # at most 32
    r = r.select(*library.columns, "_mask", *_keys(own, F.col("_mask")))
    covered = F.filter(F.array(*map(F.lit, masks)).cast("array<int>"), lambda m: m.bitwiseAND(_mask(own)) == m)
    c = contexts.withColumn("_mask", F.explode(covered))
    extra = [F.col(f).alias(f"context_{f}") for f in FIELDS]
    kind = ["clause_type"] if by_type else []
    c = c.select("context_id", *extra, *kind, "_mask", *_keys(own, F.col("_mask")))
    return c, r, ["_mask", *(f"_k{k}" for k in range(len(FIELDS))), *kind]


def candidates(contexts: DataFrame, library: DataFrame, *, by_type: bool = True) -> DataFrame:
    """context_id and the reference's columns, where no scope of the reference contradicts the context.

    Null scopes of a reference are unrestricted. A reference is keyed by its mask, which scopes it sets, and their values; a context asks with
    each mask that occurs in the library (at most 2 ** 5 of them) and that its own set scopes cover. The two meet in an equi-join on mask
    and values, without residual conditions, so references of one tenant or of none never share one key for all contexts.
    """
    c, r, names = _sides(contexts, library, by_type)
    return c.join(r, names).select("context_id", *library.columns, *(f"context_{f}" for f in FIELDS))


def is_active(as_of: Column) -> Column:
    """Approved, already effective, not expired."""
    return (
        (F.col("approval_status") == "approved")
        & F.coalesce(F.col("expiry_date") >= as_of, F.lit(True))
        & F.coalesce(F.col("effective_date") <= as_of, F.lit(True))
    )


def match_level() -> Column:
    """Number (from 1) of the first level at which a candidate row matches its context; null if it matches none."""
    level = F.lit(None).cast("int")
    for number, (_, fields) in reversed(list(enumerate(rules.STANDARD_LEVELS, start=1))):
        fits = F.lit(True)
        for f in fields:
            fits &= F.col(f"context_{f}").isNotNull() & F.col(f).eqNullSafe(F.col(f"context_{f}"))
        for f in rules.NARROWING_FIELDS:
            if f not in fields:
                fits &= F.col(f).isNull()
        level = F.when(fits, number).otherwise(level)
    return level


def _by_group(contexts: DataFrame, library: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(facts of each context about each group of references it meets, references with `_group`, `active` and their turn in it).

    A group holds the references of one set of scopes, clause type, source kind and activity: all match a context at the same level. So levels,
    winners and conflicts are found on groups, a few dozen a context, and no context's references gather in one task.
    """
    c, r, names = _sides(contexts, library, True)
    key = [*dict.fromkeys([*names, "clause_type", *FIELDS, "source_kind", "active"])]
    r = r.withColumn("active", is_active(as_of)).withColumn("_group", F.struct(*key))  # nulls in it are equal
    # A number of partitions that adaptive execution keeps: few references make many rows.
    r = r.repartition(int(library.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_group")
    turn = F.row_number().over(W.partitionBy("_group").orderBy(F.desc("version"), "knowledge_reference_id"))
    r = r.withColumn("_turn", turn)
    first = F.struct(F.col("version").isNull().alias("none"), (-F.col("version")).alias("version"), F.col("knowledge_reference_id").alias("id"))
    groups = r.groupBy("_group").agg(
        F.min(first).alias("first"), F.min("reference_text").alias("low"), F.max("reference_text").alias("high"),
    ).select("_group", "_group.*", "first", "low", "high")
    facts = c.join(groups, names).withColumn("own_level", F.when(F.col("active"), match_level()))
    facts = facts.withColumn("level", F.min("own_level").over(W.partitionBy("context_id")))
    facts = facts.withColumn("matched", F.col("own_level").eqNullSafe(F.col("level")) & F.col("own_level").isNotNull())
    per = W.partitionBy("context_id", "matched", "clause_type", "source_kind")
    wins = F.row_number().over(per.orderBy("first", *names)) == 1
    facts = facts.withColumns({"wins": wins, "several": F.coalesce(F.min("low").over(per) != F.max("high").over(per), F.lit(False))})
    return facts.select("_group", "context_id", *(f"context_{f}" for f in FIELDS), "level", "matched", "wins", "several"), r


def resolve(contexts: DataFrame, library: DataFrame, as_of: Column) -> DataFrame:
    """Every candidate of each context with `status` (selected, conflict, fallback, inactive), `scope_level` and `level`.

    The first level with an active match wins. There, of rows with one clause type and source kind
    the highest version is selected; if their texts differ the others are conflicts.
    """
    facts, r = _by_group(contexts, library, as_of)
    rows = r.join(facts, "_group")
    status = (
        F.when(~F.col("active"), "inactive").when(~F.col("matched"), "fallback").when(F.col("wins") & (F.col("_turn") == 1), "selected")
        .when(F.col("several"), "conflict").otherwise("same_text")
    )
    names = F.array(*[F.lit(n) for n, _ in rules.STANDARD_LEVELS])
    return rows.select(
        "context_id", *library.columns, *(f"context_{f}" for f in FIELDS), "active", "level", status.alias("status"), F.try_element_at(names, F.col("level")).alias("scope_level"),
    )


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """One row a context: scope level and the number of rows of each status."""
    count = lambda s: F.count_if(F.col("status") == s)
    return resolved.groupBy("context_id").agg(
        F.max("scope_level").alias("scope_level"), count("selected").alias("n_selected"), count("conflict").alias("n_conflicts"),
        count("fallback").alias("n_fallback"), count("inactive").alias("n_inactive"),
    )


def constraint_rows(contexts: DataFrame, library: DataFrame, as_of: Column, *, by_type: bool = True) -> DataFrame:
    """Active mandatory and prohibited references of each context, whatever their level."""
    rows = candidates(contexts, library, by_type=by_type).filter(is_active(as_of))
    return rows.filter(F.col("is_mandatory") | F.col("is_prohibited"))


def constrained_types(contracts: DataFrame, library: DataFrame, as_of: Column, flag: str) -> DataFrame:
    """contract_id, clause_type: the types of which an active reference with `flag` (is_mandatory, is_prohibited) holds for the contract.

    Scopes of contracts and of references are each made distinct before they meet, so that no pair of a contract and a reference is made.
    contracts: contract_id, the scopes and document_type.
    """
    scope = F.struct(*FIELDS)  # nulls in it are equal
    asked = contracts.select(*FIELDS).distinct().withColumn("context_id", scope)
    wanted = library.filter(is_active(as_of) & F.col(flag)).select(*FIELDS, "clause_type").distinct()
    types = candidates(asked, wanted, by_type=False).select("context_id", "clause_type").distinct()
    return contracts.select("contract_id", scope.alias("context_id")).join(types, "context_id").select("contract_id", "clause_type").distinct()


def search(queries: DataFrame, library: DataFrame, *, limit: int = 5) -> DataFrame:
    """The first references of each query's clause type: those of its business unit, then its jurisdiction, then the highest version.

    Nothing of other org profiles is found. queries: query_id, clause_type, org_profile_id, business_unit_id, jurisdiction_id.
    """
    # Of references with one org profile, unit and jurisdiction only the first `limit` can be among any query's first.
    alike = W.partitionBy("clause_type", *SCOPES[1:]).orderBy(F.desc("version"), "knowledge_reference_id")
    own = F.struct("org_profile_id")  # a null in it equals a null
    best = library.filter("approval_status = 'approved'").withColumn("_turn", F.row_number().over(alike)).filter(F.col("_turn") <= limit).withColumn("_org", own)
    orgs = F.array_distinct(F.array(F.lit(None).cast(queries.schema["org_profile_id"].dataType), F.col("org_profile_id")))
    asked = queries.withColumn("_org", F.explode(orgs)).withColumn("_org", F.struct(F.col("_org").cast(library.schema["org_profile_id"].dataType).alias("org_profile_id")))
    same = (F.col("r.clause_type") == F.col("c.clause_type")) & (F.col("r._org") == F.col("c._org"))
    pairs = asked.alias("c").join(best.alias("r"), same)
    hit = lambda f: F.coalesce((F.col(f"r.{f}") == F.col(f"c.{f}")).cast("int"), F.lit(0))
    order = [hit("business_unit_id").desc(), hit("jurisdiction_id").desc(), F.col("r.version").desc(), F.col("r.knowledge_reference_id")]
    rank = F.row_number().over(W.partitionBy("c.query_id").orderBy(*order))
    return pairs.select("c.query_id", rank.alias("rank"), "r.knowledge_reference_id", "r.version", "r.reference_text").filter(F.col("rank") <= limit)


def approved_language(contexts: DataFrame, library: DataFrame, as_of: Column) -> DataFrame:
    """context_id, approved_text: the selected standard of kind approved_clause, else the first hit of a search."""
    facts, r = _by_group(contexts, library, as_of)
    chosen = r.filter("_turn = 1 and source_kind = 'approved_clause'").join(facts.filter("matched and wins"), "_group")
    chosen = chosen.groupBy("context_id").agg(F.min_by("reference_text", "knowledge_reference_id").alias("resolved"))
    found = search(contexts.withColumn("query_id", F.col("context_id")), library, limit=1).select(F.col("query_id").alias("context_id"), F.col("reference_text").alias("found"))
    both = contexts.select("context_id").join(chosen, "context_id", "left").join(found, "context_id", "left")
    return both.select("context_id", F.coalesce("resolved", "found").alias("approved_text"))
