"""Registered queries take whole texts."""

import pytest
from pyspark.sql import functions as F

from contractlake.operators import graph, retrieval, workflow
from contractlake.plans import queries
from contractlake.streaming import streams

LATE = "x" * 70 + " "


@pytest.fixture
def documents(spark, tmp_path):
    """Documents whose words stand after character 60; ids that get no lead, and one that is a summary."""
    rows = [(11, LATE + "why"), (23, LATE + "see section 4"), (35, LATE + "who cites the liability cap"), (47, LATE + "MATCH (n) DELETE n"), (59, LATE + "vendor, same clause, judgement: Other Co is the vendor"), (7, LATE + "remove it")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_questions_are_whole_texts(spark, documents):
    got = {r["question_id"]: (r["style"], r["routes"], r["topic"]) for r in queries.QUERIES["q1_q4_classify_whole"](spark, documents).collect()}
    assert got[11][0] == "semantic" and got[23][0] == "exact_match" and got[35][2] == "liability_cap"
    assert {r["question_id"] for r in queries.QUERIES["q6_mutating_whole"](spark, documents).filter("mutates").collect()} == {47, 7}
    assert {r["question_id"]: r["vendor"] for r in queries.QUERIES["q5_template_vendor_whole"](spark, documents).filter(F.col("vendor").isNotNull()).collect()} == {59: "Other Co"}


def test_searches_ask_of_all_tenants(spark, tmp_path):
    rows = [(i, i % 10, [float(i % 11), float(i % 13), 1.0]) for i in range(700)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("r6_r7_dense_top_k_50", "r8_tenant_top_k_50", "r6_blocked_top_k_50"):
        asked = {r["query_id"] for r in queries.QUERIES[name](spark, str(tmp_path)).select("query_id").distinct().collect()}
        assert asked == set(range(0, 700, 50)), name
    assert {i % 7 for i in asked} == set(range(7))
    assert queries.QUERIES["e6_leakage_50"](spark, str(tmp_path)).first()["leaks"] > 0


def test_blocked_search_gives_ties_to_the_smallest_ids(spark):
    """Copies of one vector, the largest ids first: many more tie at the cut than are kept."""
    copies = [(i, i % 50, [0.3, 0.1, 0.7]) for i in range(400, 0, -1)]
    v = spark.createDataFrame(copies, "chunk_id long, contract_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(0, 0, [0.3, 0.1, 0.7])], "query_id long, contract_id long, query_vector array<double>")
    for block in (8192, 64):
        got = retrieval.blocked_top_k(q, v, 3, block=block).orderBy("rank").collect()
        assert [(r["chunk_id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    edges = graph.same_clause_edges(v.withColumnRenamed("chunk_id", "clause_id"), blocked=True)
    assert {r["dst"] for r in edges.filter("src = 400").collect()} == {1, 2, 3}


def test_only_deciding_events_of_a_job_come_together(spark):
    names = ["note", None, "revise", "revise", "note", "revise", "note", "revise", "revise", "proceed", "reject", "escalate"]
    rows = [(job, (i * 7 + job) % 40, i, names[(i * 5 + job * 3) % (12 if job % 2 else 9)]) for job in range(1, 30) for i in range(job)] + [(98, i, i, "note") for i in range(9)] + [(99, i, i, "revise") for i in range(3000)]
    df = spark.createDataFrame(rows, "job_id long, event_time int, event_id int, decision string")
    ends = {"proceed": "finalized", "reject": "rejected", "escalate": "escalated"}
    for revisions in (0, 3):
        want = {}
        for job in {r[0] for r in rows}:
            outcome, count = "open", 0
            for *_, decision in sorted((r for r in rows if r[0] == job), key=lambda r: r[1:3]):
                count += decision == "revise"
                outcome = ends.get(decision, "escalated" if decision == "revise" and count > revisions else "open")
                if outcome != "open":
                    break
            want[job] = (outcome, min(count, revisions))
        assert {o for o, _ in want.values()} >= {"open", "escalated", "finalized"}
        for f in (workflow.job_outcomes, workflow.job_outcomes_pandas):
            out = f(df, revisions=revisions)
            assert {r["job_id"]: (r["outcome"], r["revisions"]) for r in out.collect()} == want
            assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
        most = workflow.deciding_events(df, revisions=revisions).groupBy("job_id").count().agg(F.max("count")).first()[0]
        assert most <= 3 * (revisions + 1)


def test_requests_of_a_key_pass_in_batches(spark):
    rows = [(k, i, float(i * 13 % 97)) for k in (None, "a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "key string, request_id long, at double")
    want = {}
    for k in (None, "a", "b"):
        times = []
        for _, i, at in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            times = [t for t in times if at - t <= 10]
            want[k, i] = len(times) < 3
            times += [at] * want[k, i]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = streams.admissions(df, most=3, seconds=10)
        assert {(r["key"], r["request_id"]): r["accepted"] for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
