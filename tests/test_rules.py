import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from contractlake.functions import columns as C
from contractlake.operators import compliance, graph, portfolio, questions, retrieval, scoring, sensitivity, standards, workflow


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "days"), [("thirty (30) days", [30]), ("90 Days or 1 year", [90, 365]), ("2 months", [60]), ("soon", [])])
def test_durations(spark, text, days):
    assert one(spark, C.duration_days(F.col("t")), t=text) == days


def test_conflicts_only_across_contracts(spark):
    rows = [("s", 1, "a", "t", "30 days"), ("s", 1, "b", "t", "90 days"), ("s", 2, "c", "t", "31 days"), ("s", 3, "d", "t", "none"), ("z", 4, "e", "t", "90 days"), ("s", 5, "f", "u", "90 days")]
    df = spark.createDataFrame(rows, "scope string, contract_id int, clause_id string, clause_type string, text string")
    got = {(r["clause_a"], r["clause_b"], r["delta_days"]) for r in portfolio.conflicting_pairs(df, scope="scope").collect()}
    assert got == {("b", "c", 59)}
    spread = portfolio.term_spread(df, scope="scope").filter("scope = 's' and clause_type = 't'").first()
    assert (spread["spread_days"], spread["n_contracts"]) == (60, 2)


def test_clause_rules(spark):
    rows = [(1, "a", " Termination ", "x"), (1, "b", "termination", "shall Auto-Renew"), (1, "c", "payment", "x"), (1, "d", "payment", "y"), (1, "e", "liability", "no limitation of liability"), (1, "f", "other", "unlimited liability")]
    df = spark.createDataFrame(rows, "contract_id int, clause_id string, clause_type string, text string")
    assert [r["clause_ids"] for r in compliance.duplicate_types(df).collect()] == [["a", "b"]]
    assert [(r["clause_id"], r["evidence"]) for r in compliance.auto_renewal(df).collect()] == [("b", "Auto-Renew")]
    assert [r["clause_id"] for r in compliance.unlimited_liability(df).collect()] == ["e"]


def test_missing_clauses_and_checklists(spark):
    contracts = spark.createDataFrame([(1, " Supply "), (2, None)], "contract_id int, document_type string")
    clauses = spark.createDataFrame([(1, "TERMINATION"), (1, "liability_cap"), (2, "governing_law")], "contract_id int, clause_type string")
    got = {(r["contract_id"], r["clause_type"]) for r in compliance.missing_clauses(contracts, clauses).collect()}
    assert got == {(1, "confidentiality"), (1, "governing_law"), (2, "termination"), (2, "liability_cap"), (2, "confidentiality")}


def test_governing_law_needs_both_sides(spark):
    c = spark.createDataFrame([(1, 1, " in "), (2, 1, "US"), (3, 1, None), (4, 2, "US")], "contract_id int, org_profile_id int, governing_law_country string")
    e = spark.createDataFrame([(1, None, "IN"), (2, None, None)], "org_profile_id int, override_country string, default_country string")
    assert [r["contract_id"] for r in compliance.governing_law(c, e).collect()] == [2]


def test_figures(spark):
    s = spark.createDataFrame([(1, "pays 1,000 or 999 or 5,000.50", 1000.4), (2, "pays 12345", None)], "brief_id int, text string, monetary_value double")
    assert {(r["brief_id"], r["figure"]) for r in compliance.ungrounded_figures(s).collect()} == {(1, "5,000.50"), (2, "12345")}


LIBRARY = "knowledge_reference_id int, customer_id int, org_profile_id int, business_unit_id int, jurisdiction_id int, document_type string, clause_type string, reference_text string, source_kind string, approval_status string, is_mandatory boolean, is_prohibited boolean, effective_date date, expiry_date date, version int"
CONTEXT = "context_id int, customer_id int, org_profile_id int, business_unit_id int, jurisdiction_id int, document_type string, clause_type string"


def ref(i, cust=None, org=None, unit=None, jur=None, doc=None, text="t", kind="approved_clause", status="approved", start=None, end=None, version=1):
    return (i, cust, org, unit, jur, doc, "termination", text, kind, status, False, False, start, end, version)


def resolved(spark, refs, **context):
    c = (1, context.get("cust"), context.get("org"), context.get("unit"), context.get("jur"), context.get("doc"), "termination")
    out = standards.resolve(spark.createDataFrame([c], CONTEXT), spark.createDataFrame(refs, LIBRARY), F.lit(date(2024, 1, 1)))
    return {r["knowledge_reference_id"]: (r["status"], r["scope_level"]) for r in out.collect()}


def test_standard_precedence(spark):
    refs = [ref(1), ref(2, org=7), ref(3, org=7, jur=3), ref(4, org=7, unit=5, jur=3), ref(5, org=8)]
    level = "business_unit_jurisdiction_document_type"
    assert resolved(spark, refs, org=7, unit=5, jur=3, cust=1) == {1: ("fallback", level), 2: ("fallback", level), 3: ("fallback", level), 4: ("selected", level)}
    level = "organization_document_type"
    assert resolved(spark, refs, org=7, cust=1) == {1: ("fallback", level), 2: ("selected", level)}


def test_standard_isolation_dates_and_conflicts(spark):
    assert resolved(spark, [ref(1, cust=2), ref(2, doc="supply")], cust=1, doc="service") == {}
    level = "customer_group_fallback"
    refs = [ref(1, end=date(2020, 1, 1)), ref(2, start=date(2030, 1, 1)), ref(3, status="draft"), ref(4, text="a", version=1), ref(5, text="b", version=9)]
    got = resolved(spark, refs, cust=1)
    assert got == {1: ("inactive", level), 2: ("inactive", level), 3: ("inactive", level), 4: ("conflict", level), 5: ("selected", level)}


def test_confidentiality(spark):
    rows = [
        (1, "STRICTLY  confidential", None, "public", 0.2, 0.0), (2, "merger", None, "public", 0.9, 0.0), (3, "nothing", None, "public", 0.9, 0.0),
        (4, "salary", None, "internal", 0.9, 0.6), (5, "x", "NDA", "confidential", 0.8, 0.9), (6, "public filing", None, "public", 0.7, 0.0),
    ]
    df = spark.createDataFrame(rows, "document_id int, text string, document_type string, model_level string, model_confidence double, ocr_ratio double")
    got = {r["document_id"]: (r["level"], r["confidence"], r["needs_confirmation"]) for r in sensitivity.combine(sensitivity.classify(df)).collect()}
    assert got == {
        1: ("highly_confidential", 0.9, False), 2: ("highly_confidential", 0.5, True), 3: ("internal", 0.9, True),
        4: ("confidential", 0.4, False), 5: ("confidential", 0.4, True), 6: ("public", 0.9, False),
    }


def test_access(spark):
    docs = spark.createDataFrame([(1, "highly_confidential"), (2, None), (3, "odd")], "document_id int, confidentiality_level string")
    table = sensitivity.access_table(spark)
    assert {r["document_id"] for r in sensitivity.readable(docs, table, "reviewer").collect()} == {2, 3}
    assert sensitivity.readable(docs, table, "clo").count() == 0


def test_confidence_and_roles(spark):
    df = spark.createDataFrame([(1, 0.5, None, 0.5), (2, None, None, None), (3, 0.9, 0.2, 0.9)], "i int, ocr_quality double, retrieval_relevance double, llm_confidence double")
    got = {r["i"]: (r["composite"], r["reason"]) for r in scoring.low_confidence_reason(df).collect()}
    assert got == {1: (0.5, "low confidence: source OCR quality 50%"), 2: (None, None), 3: (0.69, "low confidence: retrieval relevance 20%")}
    role = lambda s, c, bar=None: one(spark, scoring.assigned_role(F.col("s"), F.col("c"), F.col("bar")), s=s, c=c, bar=bar)
    assert [role("high", 0.9), role("medium", 0.5), role("low", 0.1), role("high", 0.9, "medium")] == ["senior_counsel", "senior_counsel", "reviewer", "reviewer"]


def test_fusion_does_not_depend_on_order(spark):
    d = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (1, "c", 0.5)], "query_id int, chunk_id string, score double")
    s = spark.createDataFrame([(1, "b", 7.0), (1, "d", 7.0)], "query_id int, chunk_id string, score double")
    a = {(r["chunk_id"], round(r["score"], 9)) for r in retrieval.fuse_convex(d, s, 0.4).collect()}
    b = {(r["chunk_id"], round(r["score"], 9)) for r in retrieval.fuse_convex(d.orderBy("score"), s.orderBy(F.desc("chunk_id")), 0.4).collect()}
    assert a == b == {("a", 0.4), ("b", 0.6), ("c", 0.2), ("d", 0.6)}


def test_sparse_zero_rows_fill_up(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, "gamma"), (4, "alpha")], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "beta"), (2, "nowhere")], "query_id int, query string")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.sparse_top_k(queries, chunks, 2, zero_rows=True).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 1, (2, 2): 2}


def test_blocked_search_equals_expressions(spark):
    rows = [(i, i % 3, [float((i * 7 + j * 3) % 5 - 2) for j in range(4)]) for i in range(30)]
    v = spark.createDataFrame(rows, "clause_id long, contract_id long, embedding array<double>")
    key = lambda df: {(r["src"], r["dst"], round(r["similarity"], 9)) for r in df.collect()}
    assert key(graph.same_clause_edges(v, k=30, least=0.5, blocked=False)) == key(graph.same_clause_edges(v, k=30, least=0.5, blocked=True))


@pytest.mark.parametrize(
    ("q", "style", "routes"),
    [
        ('find "force majeure" now', "exact_match", ["hybrid"]), ("why is it so", "semantic", ["hybrid"]), ("Summary?", "balanced", ["whole_document"]),
        ("indemnity in another contract", "balanced", ["hybrid", "graph"]), ("who cites it", "balanced", ["graph"]), ("fees", "balanced", ["hybrid"]), ("Smith v. Jones", "exact_match", ["hybrid"]),
    ],
)
def test_questions(spark, q, style, routes):
    row = questions.classify(spark.createDataFrame([(1, q)], "question_id int, question string")).first()
    assert (row["style"], row["routes"]) == (style, routes)


def test_model_decides_only_open_questions(spark):
    q = spark.createDataFrame([(1, "fees"), (2, "fees"), (3, "who cites it")], "question_id int, question string")
    d = spark.createDataFrame([(1, ["direct", "graph"]), (2, ["nonsense"]), (3, ["direct"])], "question_id int, decided array<string>")
    assert {r["question_id"]: r["routes"] for r in questions.classify(q, d).collect()} == {1: ["graph"], 2: ["hybrid"], 3: ["graph"]}


def test_templates_and_mutations(spark):
    assert one(spark, questions.template_vendor(F.col("q")), q="same clause, several judgments, where Acme Corp is the vendor") == "Acme Corp"
    assert [one(spark, questions.mutates(F.col("q")), q=q) for q in ("match (n) return n", "MATCH (n) set n.x=1", "MATCH (n) RETURN n.dataset", "load  csv")] == [False, True, False, True]


def test_chain_progress(spark):
    rows = [(1, 1, "approve"), (1, 2, "reject"), (1, 3, None), (2, 1, "approve"), (2, 2, "approve_with_changes"), (3, 1, "approve"), (3, 2, None)]
    p = workflow.chain_progress(spark.createDataFrame(rows, "brief_id int, sequence int, decision string").withColumn("required_role", F.lit("r")))
    assert {(r["brief_id"], r["sequence"]): r["status"] for r in p.collect()}[(1, 3)] == "skipped"
    assert {r["brief_id"]: r["status"] for r in workflow.brief_status(p).collect()} == {1: "rejected", 2: "approved_with_changes", 3: "in_review"}
    assert {r["brief_id"]: r["sequence"] for r in workflow.next_steps(p).collect()} == {3: 2}


def test_job_outcomes_agree(spark):
    rows = [(1, 1, 1, "revise"), (1, 2, 2, "proceed"), (1, 3, 3, "reject"), *[(2, i, i, "revise") for i in range(5)], (3, 1, 1, "escalate")]
    df = spark.createDataFrame(rows, "job_id long, event_time int, event_id int, decision string")
    want = {1: ("finalized", 1), 2: ("escalated", 3), 3: ("escalated", 0)}
    for f in (workflow.job_outcomes, workflow.job_outcomes_pandas):
        assert {r["job_id"]: (r["outcome"], r["revisions"]) for r in f(df).collect()} == want


def test_seniority(spark):
    may = lambda a, b: one(spark, workflow.may_act(F.col("a"), F.col("b")), a=a, b=b)
    assert [may("reviewer", "clo"), may("admin", "clo"), may("guest", "reviewer"), may("reviewer", None)] == [False, True, False, True]


def test_candidates_by_masks_equal_all_pairs(spark):
    rng = random.Random(8)
    pick = lambda n: rng.choice([None, *range(n)])
    fields = ("customer_id", "org_profile_id", "business_unit_id", "jurisdiction_id")
    contexts = [(i, pick(2), pick(3), pick(2), pick(2), rng.choice([None, "nda", "supply"]), rng.choice("xy")) for i in range(60)]
    library = [(i, pick(2), pick(3), pick(2), pick(2), rng.choice([None, "nda", "supply"]), rng.choice("xy")) for i in range(80)]
    scopes = ", ".join(f"{f} int" for f in fields) + ", document_type string, clause_type string"
    c, r = spark.createDataFrame(contexts, f"context_id int, {scopes}"), spark.createDataFrame(library, f"knowledge_reference_id int, {scopes}")
    for by_type in (True, False):
        out = standards.candidates(c, r, by_type=by_type)
        want = sorted((a[0], b[0]) for a in contexts for b in library if all(y is None or x == y for x, y in zip(a[1:6], b[1:6])) and (not by_type or a[6] == b[6]))
        assert sorted(map(tuple, out.select("context_id", "knowledge_reference_id").collect())) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert standards.candidates(c, r.filter("false")).count() == 0
