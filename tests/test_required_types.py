"""Types that references demand of contracts: as all pairs give them, without making all pairs."""

import random
from datetime import date

from pyspark.sql import functions as F
from test_rules import CONTEXT, LIBRARY, ref

from contractlake.operators import standards

AS_OF = date(2024, 1, 1)


def test_equal_all_pairs(spark):
    rng = random.Random(5)
    pick = lambda n: rng.choice([None, *range(n)])
    asked = [(i // 2, pick(2), pick(3), pick(2), pick(2), rng.choice([None, "nda", "supply"]), None) for i in range(60)]
    refs = [ref(i, pick(2), pick(3), pick(2), pick(2), rng.choice([None, "nda"]), end=rng.choice([None, date(2020, 1, 1)])) for i in range(40)]
    refs = [(*r[:6], rng.choice("xyz"), *r[7:10], rng.random() < 0.5, *r[11:]) for r in refs]
    contracts = spark.createDataFrame(asked, CONTEXT).withColumnRenamed("context_id", "contract_id")
    got = standards.constrained_types(contracts, spark.createDataFrame(refs, LIBRARY), F.lit(AS_OF), "is_mandatory").collect()
    fits = lambda a, r: r[10] and r[13] is None and all(y is None or x == y for x, y in zip(a[1:6], r[1:6]))
    want = {(a[0], r[6]) for a in asked for r in refs if fits(a, r)}
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_many_contracts_and_references(spark):
    """Four thousand million pairs, made by none."""
    n = 60_000
    contracts = spark.range(n).selectExpr("id AS contract_id", *(f"CAST(1 AS INT) AS {f}" for f in standards.SCOPES), "'nda' AS document_type")
    one = spark.createDataFrame([ref(0)], LIBRARY).drop("knowledge_reference_id", "is_prohibited")
    library = spark.range(n).selectExpr("id AS knowledge_reference_id", "true AS is_prohibited").crossJoin(F.broadcast(one))
    assert standards.constrained_types(contracts, library, F.lit(AS_OF), "is_prohibited").count() == n
