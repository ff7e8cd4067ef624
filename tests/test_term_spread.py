"""The spread of durations is taken in tasks whose number grows with the clauses, and equals a loop."""

import random

from contractlake.operators import portfolio


def test_term_spread_is_dealt_by_the_number_of_clauses(spark, monkeypatch):
    monkeypatch.setattr(portfolio, "PER_TASK", 10)
    rng = random.Random(4)
    clauses = [(rng.choice([None, *range(12)]), rng.choice(["a", "b", None]), rng.choice(["Notice of 5 days", "(2) months or 1 year", "none", None])) for _ in range(120)]
    contracts = [(i, rng.choice([7, 8, None])) for i in range(12)] + [(3, 9), (3, 9)]  # one in two scopes, twice
    days = {"Notice of 5 days": 5, "(2) months or 1 year": 365}
    table = spark.createDataFrame(clauses, "contract_id long, clause_type string, text string")
    found = portfolio.term_spread(table, scope="s", contracts=spark.createDataFrame(contracts, "contract_id long, s long"))
    want = {}
    for c, kind, text in clauses:
        for i, s in contracts:
            if c == i and text in days:
                want.setdefault((s, kind), []).append((days[text], c))
    want = {k: (min(v)[0], max(v)[0], max(v)[0] - min(v)[0], len({c for _, c in v})) for k, v in want.items()}
    assert {(r["s"], r["clause_type"]): tuple(r)[2:] for r in found.collect()} == want and len(want) > 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 12)" in plan and "REPARTITION_BY_NUM" in plan
