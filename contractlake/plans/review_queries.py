"""Queries on reviews, histories, dashboards, questions, evaluation and streams (W, V, B, Q, E, X, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contractlake.functions import hooks, rules
from contractlake.operators import compliance, dashboards, evaluation, history, questions, workflow
from contractlake.plans.bindings import oracle, view
from contractlake.plans.registry import register
from contractlake.plans.rule_queries import SAME, _same
from contractlake.plans.text_queries import sql_hash
from contractlake.streaming import streams

_CHAIN = """chain AS (SELECT o_orderkey AS document_id, o_totalprice >= 300000 AS over, o_orderkey % 5 = 0 AS high, o_orderkey % 7 = 0 AS secret, o_orderkey % 11 = 0 AS clo, o_orderkey % 13 = 0 AS policy FROM orders)"""


@register(
    "w1_approval_chain",
    f"""WITH {_CHAIN}, steps AS (
      SELECT document_id, 1 AS k, 'reviewer' AS required_role FROM chain WHERE NOT policy UNION ALL SELECT document_id, 2, 'senior_counsel' FROM chain WHERE NOT policy
      UNION ALL SELECT document_id, 3, 'business_head' FROM chain WHERE NOT policy AND (over OR high) UNION ALL SELECT document_id, 4, 'clo' FROM chain WHERE NOT policy AND (secret OR clo)
      UNION ALL SELECT document_id, 1, 'clo' FROM chain WHERE policy UNION ALL SELECT document_id, 2, 'reviewer' FROM chain WHERE policy)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY k) AS sequence, required_role FROM steps""",
)
def w1(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    step = lambda role: F.struct(F.lit(role).alias("required_role"), F.lit("policy").alias("reason"))
    key = F.col("o_orderkey")
    docs = o.select(
        key.alias("document_id"), F.col("o_totalprice").alias("monetary_value"), F.when(key % 7 == 0, "highly_confidential").otherwise("internal").alias("confidentiality_level"),
        (key % 5 == 0).alias("has_high_risk"), F.lit(300000.0).alias("value_threshold"), (key % 11 == 0).alias("require_clo"),
        F.when(key % 13 == 0, F.array(step("clo"), step("reviewer"))).alias("approval_policy"),
    )
    return workflow.approval_chain(docs).select("document_id", "sequence", "required_role")


PROGRESS = """prog AS (SELECT *, CASE WHEN sequence > min(CASE WHEN decision IN ('reject', 'send_back') THEN sequence END) OVER (PARTITION BY brief_id) THEN 'skipped'
   ELSE CASE decision WHEN 'approve' THEN 'approved' WHEN 'approve_with_changes' THEN 'approved_with_changes' WHEN 'reject' THEN 'rejected' WHEN 'send_back' THEN 'sent_back' ELSE 'pending' END END AS status FROM v_step)"""


def _progress(spark, sf_dir):
    return workflow.chain_progress(view(spark, sf_dir, "v_step"))


@register("w2_chain_progress", oracle(f"WITH {PROGRESS} SELECT brief_id, sequence, status FROM prog"))
def w2(spark, sf_dir):
    return _progress(spark, sf_dir).select("brief_id", "sequence", "status")


@register("w2_brief_status", oracle(f"WITH {PROGRESS} SELECT brief_id, coalesce(max(CASE WHEN status IN ('rejected', 'sent_back') THEN status END), CASE WHEN count(*) FILTER (status = 'pending') = 0 THEN arg_max(status, sequence) ELSE 'in_review' END) AS status FROM prog GROUP BY brief_id"))
def w2_status(spark, sf_dir):
    return workflow.brief_status(_progress(spark, sf_dir))


@register("w3_next_steps", oracle(f"WITH {PROGRESS} SELECT brief_id, min(sequence) AS sequence, arg_min(required_role, sequence) AS required_role FROM prog WHERE status = 'pending' GROUP BY brief_id"))
def w3(spark, sf_dir):
    return workflow.next_steps(_progress(spark, sf_dir))


def _flags(spark, sf_dir):
    """Flags, one in five of them on the document rather than on a clause; ids of repeated lines occur once."""
    f = view(spark, sf_dir, "v_risk_flag").dropDuplicates(["risk_flag_id"])
    return f.withColumn("clause_id", F.when(F.col("page_start") % 5 != 0, F.col("clause_id")))


_FLAGS = "flags AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY risk_flag_id ORDER BY severity, confidence, fallback_source, text) AS u, count(*) OVER (PARTITION BY risk_flag_id) AS copies FROM v_risk_flag) AS x WHERE u = 1)"


@register("w4_playbook_rows", oracle(f"WITH {_FLAGS} SELECT document_id, risk_flag_id, fallback_source FROM flags"))
def w4(spark, sf_dir):
    f = _flags(spark, sf_dir)
    entries = f.select("risk_flag_id", "fallback_source")
    clauses = view(spark, sf_dir, "v_clause").select("clause_id", F.col("contract_id").alias("document_id")).distinct()
    return workflow.playbook_rows(entries, f.drop("fallback_source"), clauses).select("document_id", "risk_flag_id", "fallback_source")


@register("w5_playbook_order", oracle("SELECT risk_flag_id, row_number() OVER (PARTITION BY document_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE WHEN confidence < 0.7 THEN 1.0 ELSE confidence END, risk_flag_id) AS priority FROM v_risk_flag"))
def w5(spark, sf_dir):
    f = view(spark, sf_dir, "v_risk_flag").withColumn("confidence", F.when(F.col("confidence") >= 0.7, F.col("confidence")))
    return workflow.playbook_order(f).select("risk_flag_id", "priority")


@register("w5_playbook_summary", oracle("SELECT document_id, count(*) AS total_entries, count(*) FILTER (severity = 'high') AS high_severity, count(*) FILTER (fallback_source = 'org_profile') AS org_profile_sourced, count(*) FILTER (fallback_source = 'llm_generated') AS llm_sourced FROM v_risk_flag GROUP BY 1"))
def w5_summary(spark, sf_dir):
    return workflow.playbook_summary(view(spark, sf_dir, "v_risk_flag"))


@register("w6_fallbacks", oracle("SELECT risk_flag_id, CASE WHEN contract_id % 3 = 0 THEN concat('approved ', contract_id) ELSE concat('redline ', risk_flag_id) END AS suggested_redline, CASE WHEN contract_id % 3 = 0 THEN 'org_profile' ELSE 'llm_generated' END AS fallback_source, CASE WHEN contract_id % 3 = 0 THEN 2 ELSE 1 END AS n_positions FROM (SELECT DISTINCT risk_flag_id, contract_id, severity, text FROM v_risk_flag) AS x WHERE severity IN ('medium', 'high')"))
def w6(spark, sf_dir):
    f = view(spark, sf_dir, "v_risk_flag").select("risk_flag_id", F.col("contract_id").alias("context_id"), "severity", "text").distinct()
    approved = view(spark, sf_dir, "v_contract").filter("contract_id % 3 = 0").select(F.col("contract_id").alias("context_id"), F.concat(F.lit("approved "), "contract_id").alias("approved_text"))
    made = f.select("risk_flag_id").distinct().select("risk_flag_id", F.array(F.lit("x")).alias("positions"), F.concat(F.lit("redline "), "risk_flag_id").alias("redline"))
    out = workflow.fallbacks(f, approved, made)
    return out.select("risk_flag_id", "suggested_redline", "fallback_source", F.size("fallback_positions").alias("n_positions"))


_ROLE = lambda x: f"CASE {x} % 6 WHEN 0 THEN 'reviewer' WHEN 1 THEN 'senior_counsel' WHEN 2 THEN 'business_head' WHEN 3 THEN 'clo' WHEN 4 THEN 'admin' ELSE 'guest' END"
_SENIOR = lambda x, d: f"CASE {x} % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE {d} END"


@register("w7_seniority", f"SELECT event_id, {_SENIOR('event_id', -1)} >= {_SENIOR('user_id', 0)} AS allowed FROM events")
def w7(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", workflow.may_act(F.expr(_ROLE("event_id")), F.expr(_ROLE("user_id"))).alias("allowed"))


@register("w8_decision_problems", oracle("SELECT brief_id, sequence, CASE WHEN decision IS NULL THEN 'unknown decision' WHEN decision = 'reject' AND sequence % 2 = 0 THEN 'comments required' WHEN decision = 'approve_with_changes' THEN 'required changes missing' WHEN decision = 'send_back' AND sequence % 3 <> 0 THEN 'reason required' END AS problem FROM v_step"))
def w8(spark, sf_dir):
    s = view(spark, sf_dir, "v_step")
    problem = workflow.decision_problem(F.col("decision"), F.when(F.col("sequence") % 2 == 1, "no"), F.lit(" "), F.when(F.col("sequence") % 3 == 0, "why"))
    return s.select("brief_id", "sequence", problem.alias("problem"))


@register("w8_unreviewed", oracle("SELECT contract_id AS document_id FROM v_contract WHERE contract_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"))
def w8_unreviewed(spark, sf_dir):
    actions = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"))
    return workflow.unreviewed(view(spark, sf_dir, "v_contract").select(F.col("contract_id").alias("document_id")), actions)


@register("w9_brief_inputs")
def w9(spark, sf_dir):
    docs = view(spark, sf_dir, "v_contract").select(F.col("contract_id").alias("document_id"), "document_type", "monetary_value")
    clauses = view(spark, sf_dir, "v_clause").select(F.col("contract_id").alias("document_id"), "clause_id", "clause_type", "text")
    flags = view(spark, sf_dir, "v_risk_flag").select("document_id", "risk_flag_id", "severity")
    return workflow.brief_inputs(docs, {"clauses": clauses, "flags": flags})


_BRIEF = "CASE o_orderstatus WHEN 'P' THEN 'sent_back' WHEN 'F' THEN 'approved' ELSE 'in_review' END"


@register("w10_brief_versions", f"SELECT document_id, brief_id, version_number, CASE WHEN status = 'sent_back' AND nxt IS NOT NULL THEN version_number + 1 END AS superseded_by_version, CASE WHEN brief_id % 5 = 0 THEN 'escalate' ELSE 'approve' END AS recommendation FROM (SELECT o_custkey AS document_id, o_orderkey AS brief_id, {_BRIEF} AS status, row_number() OVER w AS version_number, lead(1) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS x")
def w10(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    briefs = o.select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("brief_id"), F.expr(_BRIEF).alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, "maybe").otherwise("approve").alias("recommendation"), F.col("o_orderdate").alias("created_at"),
    )
    return workflow.brief_versions(briefs).drop("status", "created_at")


def _decisions(spark, sf_dir):
    decision = F.when(F.col("event_id") % 23 == 0, "proceed").when(F.col("event_id") % 29 == 0, "reject").when(F.col("event_id") % 31 == 0, "escalate").otherwise("revise")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("ts").alias("event_time"), "event_id", decision.alias("decision"))


_OUTCOMES = """WITH d AS (SELECT user_id AS job_id, ts, event_id, CASE WHEN event_id % 23 = 0 THEN 'finalized' WHEN event_id % 29 = 0 THEN 'rejected' WHEN event_id % 31 = 0 THEN 'escalated' END AS ending FROM events),
o AS (SELECT *, row_number() OVER w AS r, count(*) FILTER (ending IS NULL) OVER w AS again FROM d WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT *, ending IS NOT NULL OR again > 3 AS ends FROM o)
SELECT job_id, coalesce(arg_min(coalesce(ending, 'escalated'), r) FILTER (ends), 'open') AS outcome, least(coalesce(arg_min(again, r) FILTER (ends), max(again)), 3) AS revisions FROM e GROUP BY job_id"""


@register("w11_job_outcomes", _OUTCOMES)
def w11(spark, sf_dir):
    return workflow.job_outcomes(_decisions(spark, sf_dir))


@register("u4_job_outcomes_grouped", _OUTCOMES)
def u4(spark, sf_dir):
    return workflow.job_outcomes_pandas(_decisions(spark, sf_dir))


@register("w12_approval_state", oracle("SELECT contract_id, CASE d WHEN 'approve' THEN true WHEN 'reject' THEN false END AS approved, CASE d WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'awaiting_review' END AS status FROM (SELECT brief_id AS contract_id, CASE arg_max(coalesce(decision, 'escalate'), sequence) WHEN 'approve' THEN 'approve' WHEN 'reject' THEN 'reject' ELSE 'escalate' END AS d FROM v_step GROUP BY 1) AS x"))
def w12(spark, sf_dir):
    s = view(spark, sf_dir, "v_step")
    return workflow.approval_state(s.select(F.col("brief_id").alias("contract_id"), F.coalesce("decision", F.lit("escalate")).alias("decision"), F.col("sequence").alias("seq")))


def _missing(spark, sf_dir):
    return compliance.missing_clauses(view(spark, sf_dir, "v_contract"), view(spark, sf_dir, "v_clause"))


EXPECTED = "expected AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, ts in rules.EXPECTED_CLAUSES.items() for t in ts) + ") AS v(document_type, clause_type))"
MISSING = "miss AS (SELECT contract_id, e.clause_type FROM v_contract JOIN expected AS e USING (document_type) WHERE NOT EXISTS (SELECT 1 FROM v_clause AS l WHERE l.contract_id = v_contract.contract_id AND l.clause_type = e.clause_type))"


@register(
    "w13_approval_summary",
    oracle(f"""WITH {EXPECTED}, {MISSING} SELECT c.contract_id, coalesce(a.n, 0) AS n_clauses, coalesce(k.n, 0) AS n_conflicts, coalesce(h.n, 0) AS n_high_risk, coalesce(m.n, 0) AS n_missing FROM v_contract AS c
      LEFT JOIN (SELECT contract_id, count(*) AS n FROM v_clause GROUP BY 1) AS a USING (contract_id) LEFT JOIN (SELECT contract_id, count(*) AS n FROM v_risk_flag WHERE severity = 'high' GROUP BY 1) AS h USING (contract_id)
      LEFT JOIN (SELECT contract_id, count(*) AS n FROM v_clause WHERE clause_type = 'renewal' GROUP BY 1) AS k USING (contract_id) LEFT JOIN (SELECT contract_id, count(*) AS n FROM miss GROUP BY 1) AS m USING (contract_id)"""),
)
def w13(spark, sf_dir):
    clauses = view(spark, sf_dir, "v_clause")
    return workflow.approval_summary(view(spark, sf_dir, "v_contract"), clauses, clauses.filter("clause_type = 'renewal'"), view(spark, sf_dir, "v_risk_flag"), _missing(spark, sf_dir))


@register("w13_high_risk_details")
def w13_details(spark, sf_dir):
    clauses = view(spark, sf_dir, "v_clause").dropDuplicates(["clause_id"])
    return workflow.high_risk_details(_flags(spark, sf_dir).drop("text"), clauses)


@register("v1_append_versions", oracle("SELECT v.document_id, v.version_number + m.n AS version_number, v.is_ai_generated, v.summary_text FROM v_version AS v JOIN (SELECT document_id, max(version_number) AS n FROM v_version GROUP BY 1) AS m USING (document_id)"))
def v1(spark, sf_dir):
    stored = view(spark, sf_dir, "v_version")
    new = stored.select("document_id", "summary_text", "edited_by", F.struct("created_at", "version_number").alias("created_at"))
    return history.append_versions(stored, new).select("document_id", "version_number", "is_ai_generated", "summary_text")


@register("v2_latest_versions", oracle("SELECT document_id, max(version_number) AS version_number, arg_max(summary_text, version_number) AS summary_text FROM v_version GROUP BY 1"))
def v2(spark, sf_dir):
    return history.latest_versions(view(spark, sf_dir, "v_version")).select("document_id", "version_number", "summary_text")


def _approvals(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 12).cast("int").alias("version_number"))


@register("v3_approved_versions", oracle("SELECT document_id, version_number, CASE WHEN version_number = document_id % 12 THEN 'approved' ELSE 'draft' END AS approval_status FROM v_version"))
def v3(spark, sf_dir):
    return history.approve_versions(view(spark, sf_dir, "v_version"), _approvals(spark, sf_dir))[0].select("document_id", "version_number", "approval_status")


@register("v3_unknown_versions", oracle("SELECT c_custkey AS document_id, c_custkey % 12 AS version_number FROM customer WHERE NOT EXISTS (SELECT 1 FROM v_version WHERE document_id = c_custkey AND version_number = c_custkey % 12)"))
def v3_unknown(spark, sf_dir):
    return history.approve_versions(view(spark, sf_dir, "v_version"), _approvals(spark, sf_dir))[1]


@register("v4_restored_versions", oracle("SELECT v.document_id, m.n + 1 AS version_number, v.summary_text, v.version_number AS restored_from_version FROM v_version AS v JOIN (SELECT document_id, max(version_number) AS n FROM v_version GROUP BY 1) AS m USING (document_id) WHERE v.version_number = 2"))
def v4(spark, sf_dir):
    versions = view(spark, sf_dir, "v_version")
    asked = versions.filter("version_number = 2").select("document_id", "version_number", F.lit("editor").alias("edited_by"), "created_at")
    return history.restore_versions(versions, asked).select("document_id", "version_number", "summary_text", "restored_from_version")


@register("v5_audit_trail", oracle("SELECT audit_id, job_id, action, row_number() OVER (PARTITION BY job_id ORDER BY event_time, audit_id) AS sequence FROM v_audit_event"))
def v5(spark, sf_dir):
    return history.audit_trail(view(spark, sf_dir, "v_audit_event")).select("audit_id", "job_id", "action", "sequence")


@register("v6_visible_turns", oracle("SELECT document_id, turn FROM v_chat WHERE document_id % 3 <> 0 OR turn > document_id % 5"))
def v6(spark, sf_dir):
    chat = view(spark, sf_dir, "v_chat")
    cleared = chat.select("document_id").distinct().filter("document_id % 3 = 0").withColumn("cleared_at", F.col("document_id") % 5)
    return history.visible_turns(chat, cleared).select("document_id", "turn")


LEVELS = """kept AS (SELECT * FROM (SELECT *, coalesce(bool_or(source = 'manual') OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS fixed FROM v_level_change) AS x WHERE source = 'manual' OR NOT fixed)"""


@register("v8_confidentiality_history", oracle(f"WITH {LEVELS} SELECT document_id, seq, lag(new_level) OVER (PARTITION BY document_id ORDER BY seq) AS previous_level, new_level FROM kept"))
def v8(spark, sf_dir):
    return history.confidentiality_history(view(spark, sf_dir, "v_level_change")).select("document_id", "seq", "previous_level", "new_level")


@register("v8_current_levels", oracle(f"WITH {LEVELS} SELECT document_id, arg_max(new_level, seq) AS level, arg_max(source, seq) AS source FROM kept GROUP BY 1"))
def v8_current(spark, sf_dir):
    return history.current_levels(history.confidentiality_history(view(spark, sf_dir, "v_level_change")))


ACTIONS = ["query_received", "retrieval_completed", "draft_answer_generated", "review_approved", "answer_rejected"]


@register("v10_action_counts", oracle("SELECT job_id AS reviewer, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in ACTIONS) + " FROM v_audit_event GROUP BY 1"))
def v10(spark, sf_dir):
    return history.action_counts(view(spark, sf_dir, "v_audit_event").withColumnRenamed("job_id", "reviewer"), ACTIONS)


@register("b1_jobs_by_status", oracle("SELECT status, count(*) AS n FROM v_contract GROUP BY 1"))
def b1(spark, sf_dir):
    return dashboards.count_by(view(spark, sf_dir, "v_contract"), "status")


@register("b2_flags_rollup", oracle("SELECT severity, category, count(*) AS n FROM v_risk_flag GROUP BY ROLLUP (severity, category)"))
def b2(spark, sf_dir):
    return dashboards.flags_by_level(view(spark, sf_dir, "v_risk_flag"), rollup=True)


@register("b3_totals", oracle(f"WITH {EXPECTED}, {MISSING} SELECT (SELECT count(*) FROM miss) AS missing_clauses, (SELECT count(*) FROM v_clause WHERE clause_type = 'renewal') AS conflict_pairs, (SELECT count(*) FROM v_contract) AS contracts"))
def b3(spark, sf_dir):
    return dashboards.totals(_missing(spark, sf_dir), view(spark, sf_dir, "v_clause").filter("clause_type = 'renewal'"), view(spark, sf_dir, "v_contract"))


@register("b4_latest_job_status", oracle("SELECT status, count(*) AS n_jobs FROM (SELECT job_id, arg_max(action, audit_id) AS status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_time DESC, audit_id DESC) AS r FROM v_audit_event) AS x WHERE r = 1 GROUP BY 1) AS y GROUP BY 1"))
def b4(spark, sf_dir):
    return dashboards.latest_job_status(view(spark, sf_dir, "v_audit_event"))


@register("b5_run_trend", "SELECT o_orderkey AS run_id, o_orderdate AS started_at, o_totalprice AS score FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def b5(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return dashboards.run_trend(o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("o_totalprice").alias("score")))


@register("b5_latest_run", "SELECT l_orderkey AS run_id, l_linenumber AS case_id FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)")
def b5_latest(spark, sf_dir):
    cases = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("case_id"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return dashboards.latest_run(o.join(cases.select("run_id"), "run_id", "left_semi"), cases)


@register("b7_document_detail")
def b7(spark, sf_dir):
    clauses = view(spark, sf_dir, "v_clause").select("contract_id", "clause_id", "clause_type", "text").dropDuplicates(["clause_id"])
    return dashboards.document_detail(view(spark, sf_dir, "v_contract"), clauses, _flags(spark, sf_dir).select("contract_id", "clause_id", "category", "severity", "confidence"))


@register("b8_listing", oracle("SELECT contract_id, contract_name, status FROM v_contract WHERE status = 'approved'"))
def b8(spark, sf_dir):
    return dashboards.listing(view(spark, sf_dir, "v_contract"), ["contract_id", "contract_name", "status"], "status = 'approved'")


_HAS = lambda words: "(" + " OR ".join(f"position('{w}' IN low) > 0" for w in words) + ")"
STYLE = rf"""CASE WHEN regexp_matches(question, '"[^"]{{3,}}"') OR regexp_matches(low, '\bsection\s+[0-9]') OR regexp_matches(low, '\bclause\s+[0-9]') OR regexp_matches(low, '\b(art\.|article)\s+[0-9]') OR regexp_matches(question, '\bv\.\s+[A-Z]') THEN 'exact_match'
   WHEN {_HAS(rules.SEMANTIC_PHRASES)} THEN 'semantic' ELSE 'balanced' END"""
WHOLE = rf"""({_HAS(rules.WHOLE_DOCUMENT_PHRASES)} OR (len(words) <= 5 AND len(list_filter(words, lambda w: w LIKE 'summar%' OR w = 'overview')) > 0))"""
TOPIC = "CASE " + " ".join(f"WHEN {_HAS(words)} THEN '{name}'" for name, words in rules.TOPICS) + " END"


# Questions are whole documents. Each query has a second name, by which it was registered before.
_WHOLE_TEXT = rf"""SELECT question_id, style, CASE style WHEN 'exact_match' THEN 0.2 WHEN 'semantic' THEN 0.7 ELSE 0.4 END AS alpha,
  CASE WHEN whole THEN 'whole_document' WHEN g AND t THEN 'hybrid,graph' WHEN g THEN 'graph' ELSE 'hybrid' END AS routes, topic
FROM (SELECT question_id, {STYLE} AS style, {WHOLE} AS whole, {_HAS(rules.GRAPH_PHRASES)} AS g, {_HAS(rules.TOPIC_PHRASES)} AS t, {TOPIC} AS topic
      FROM (SELECT *, lower(question) AS low, list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^a-z\s]', '', 'g'), '\s+'), lambda w: w <> '') AS words FROM v_whole_question) AS x) AS y"""
_VENDOR = f"trim(regexp_extract(question, '{rules.VENDOR.replace("'", "''")}', 1))"
_ASKS = "position('vendor' IN lower(question)) > 0 AND position('same clause' IN lower(question)) > 0 AND (position('judgment' IN lower(question)) > 0 OR position('judgement' IN lower(question)) > 0)"


@register("q1_q4_classify", oracle(_WHOLE_TEXT))
@register("q1_q4_classify_whole", oracle(_WHOLE_TEXT))
def q1_q4_whole(spark, sf_dir):
    out = questions.classify(view(spark, sf_dir, "v_whole_question"))
    return out.select("question_id", "style", "alpha", F.array_join("routes", ",").alias("routes"), "topic")


@register("q5_template_vendor", oracle(f"SELECT question_id, CASE WHEN {_ASKS} AND {_VENDOR} <> '' THEN {_VENDOR} END AS vendor FROM v_whole_question"))
@register("q5_template_vendor_whole", oracle(f"SELECT question_id, CASE WHEN {_ASKS} AND {_VENDOR} <> '' THEN {_VENDOR} END AS vendor FROM v_whole_question"))
def q5_whole(spark, sf_dir):
    return view(spark, sf_dir, "v_whole_question").select("question_id", questions.template_vendor(F.col("question")).alias("vendor"))


@register("q6_mutating", oracle(rf"SELECT question_id, regexp_matches(question, '{rules.MUTATING}') AS mutates FROM v_whole_question"))
@register("q6_mutating_whole", oracle(rf"SELECT question_id, regexp_matches(question, '{rules.MUTATING}') AS mutates FROM v_whole_question"))
def q6_whole(spark, sf_dir):
    return view(spark, sf_dir, "v_whole_question").select("question_id", questions.mutates(F.col("question")).alias("mutates"))


FOUND = f"""{EXPECTED}, fnd AS (SELECT contract_id, list_sort(list(DISTINCT clause_type)) AS found, list_sort(list(DISTINCT clause_type) FILTER (severity = 'high')) AS high FROM v_clause GROUP BY 1),
exp AS (SELECT contract_id, list_sort(list(e.clause_type)) AS expected FROM v_contract JOIN expected AS e USING (document_type) GROUP BY 1),
ev AS (SELECT contract_id, coalesce(found, []) AS found, coalesce(high, []) AS high, expected FROM exp LEFT JOIN fnd USING (contract_id))"""


def _evaluated(spark, sf_dir):
    clauses = view(spark, sf_dir, "v_clause")
    high = F.array_sort(F.collect_set(F.when(F.col("severity") == "high", F.col("clause_type"))))
    found = clauses.groupBy("contract_id").agg(F.array_sort(F.collect_set("clause_type")).alias("found"), high.alias("high"))
    none = F.array().cast("array<string>")
    rows = view(spark, sf_dir, "v_contract").select("contract_id", F.array_sort(compliance.checklist(F.col("document_type"))).alias("expected"))
    rows = rows.join(found, "contract_id", "left").withColumns({"found": F.coalesce("found", none), "high": F.coalesce("high", none)})
    return rows.withColumn("scanned_without_ocr", F.col("contract_id") % 10 == 0)


@register("e1_e3_extraction_scores", oracle(f"""WITH {FOUND} SELECT contract_id, CASE WHEN contract_id % 10 > 0 THEN round(len(list_intersect(found, expected))::DOUBLE / len(expected), 9) END AS clause_recall,
   CASE WHEN len(high) > 0 THEN round(len(list_intersect(high, expected))::DOUBLE / len(high), 9) ELSE 0.0 END AS risk_precision, found = expected AS missing_match FROM ev"""))
def e1_e3(spark, sf_dir):
    rows = evaluation.clause_scores(_evaluated(spark, sf_dir))
    return rows.select(
        "contract_id", F.round("clause_recall", 9).alias("clause_recall"), F.round(evaluation.risk_precision(F.col("high"), F.col("expected")), 9).alias("risk_precision"),
        evaluation.same_set(F.col("found"), F.col("expected")).alias("missing_match"),
    )


@register("b6_evaluation_summary", oracle(f"""WITH {FOUND} SELECT round(avg(CASE WHEN contract_id % 10 > 0 THEN len(list_intersect(found, expected))::DOUBLE / len(expected) END), 9) AS mean_recall,
   round(avg(CASE WHEN len(high) > 0 THEN len(list_intersect(high, expected))::DOUBLE / len(high) ELSE 0.0 END), 9) AS mean_precision, round(avg(CASE WHEN found = expected THEN 1.0::DOUBLE ELSE 0 END), 9) AS missing_accuracy FROM ev"""))
def b6(spark, sf_dir):
    rows = evaluation.clause_scores(_evaluated(spark, sf_dir)).withColumns({
        "risk_precision": evaluation.risk_precision(F.col("high"), F.col("expected")), "missing_match": evaluation.same_set(F.col("found"), F.col("expected")),
    })
    out = dashboards.evaluation_summary(rows)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


MATRIX = "m AS (SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2)"


@register("e4_confusion", f"WITH {MATRIX} SELECT * FROM m")
def e4(spark, sf_dir):
    return evaluation.confusion(spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted")))


@register(
    "e4_class_metrics",
    f"""WITH {MATRIX}, a AS (SELECT actual AS label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS hits FROM m GROUP BY 1), p AS (SELECT predicted AS label, sum(n) AS claimed FROM m GROUP BY 1),
      x AS (SELECT label, coalesce(hits, 0)::DOUBLE / nullif(claimed, 0) AS pr, hits::DOUBLE / nullif(support, 0) AS re, coalesce(support, 0) AS support FROM a FULL JOIN p USING (label))
      SELECT label, round(coalesce(pr, 0), 9) AS precision, round(coalesce(re, 0), 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1, support FROM x""",
)
def e4_metrics(spark, sf_dir):
    out = evaluation.class_metrics(e4(spark, sf_dir))
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


_CASES = "(SELECT document_id, turn, answer, CASE WHEN turn % 3 = 0 THEN [] WHEN turn % 3 = 1 THEN ['x', answer, substr(question, 1, 20)] ELSE [substr(question, 1, 10)] END AS citations FROM v_chat WHERE answer IS NOT NULL AND answer <> '') AS c"


@register("e7_e8_citations", oracle(f"""SELECT document_id, turn, len(citations) > 0 AS has_citation, round(good::DOUBLE / nullif(len(citations), 0), 9) AS correctness, len(citations) > 0 AND coalesce(good::DOUBLE / nullif(len(citations), 0) >= 0.5, true) AS passed
   FROM (SELECT *, len(list_filter(citations, lambda z: length(trim(z)) >= 3 AND lower(trim(z)) <> lower(trim(answer)))) AS good FROM {_CASES}) AS y"""))
def e7_e8(spark, sf_dir):
    chat = view(spark, sf_dir, "v_chat")
    cites = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).when(F.col("turn") % 3 == 1, F.array(F.lit("x"), F.col("answer"), F.substring("question", 1, 20))).otherwise(F.array(F.substring("question", 1, 10)))
    out = evaluation.citation_scores(chat.withColumn("citations", cites))
    return out.select("document_id", "turn", "has_citation", F.round("correctness", 9).alias("correctness"), "passed")


@register("e9_judge_means", oracle("SELECT count(*) AS n_cases, round(avg(CASE WHEN turn % 4 = 0 THEN NULL ELSE turn::DOUBLE END), 9) AS faithfulness FROM v_chat WHERE answer IS NOT NULL AND answer <> ''"))
def e9(spark, sf_dir):
    chat = view(spark, sf_dir, "v_chat").withColumns({"contexts": F.array("question"), "reference_answer": F.lit(None).cast("string")})
    rows = evaluation.scorable(chat).withColumn("faithfulness", F.when(F.col("turn") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("turn").cast("double")))
    return rows.agg(F.count(F.lit(1)).alias("n_cases")).crossJoin(evaluation.judge_means(rows, ["faithfulness"]).select(F.round("faithfulness", 9).alias("faithfulness")))


@register(
    "e11_conflict_scores",
    oracle("""WITH sp AS (SELECT least(a.contract_id, b.contract_id) AS doc_x, greatest(a.contract_id, b.contract_id) AS doc_y, a.clause_type FROM (SELECT DISTINCT contract_id, clause_type FROM v_clause) AS a
      JOIN (SELECT DISTINCT contract_id, clause_type FROM v_clause) AS b ON b.contract_id = a.contract_id + 1 AND a.clause_type = b.clause_type)
      SELECT e.doc_x, e.doc_y, bool_or(sp.clause_type IS NOT NULL) AS found FROM (SELECT contract_id AS doc_x, contract_id + 1 AS doc_y, 'payment' AS clause_type FROM v_contract) AS e LEFT JOIN sp USING (doc_x, doc_y, clause_type) GROUP BY 1, 2"""),
)
def e11(spark, sf_dir):
    types = view(spark, sf_dir, "v_clause").select("contract_id", "clause_type").distinct()
    after = types.select((F.col("contract_id") - 1).alias("contract_id"), "clause_type", F.col("contract_id").alias("doc_a"))
    pairs = types.join(after, ["contract_id", "clause_type"]).select("doc_a", F.col("contract_id").alias("doc_b"), "clause_type")
    wanted = view(spark, sf_dir, "v_contract").select(F.col("contract_id").alias("doc_a"), (F.col("contract_id") + 1).alias("doc_b"), F.lit("payment").alias("clause_type"))
    return evaluation.conflict_scores(pairs, wanted)


@register("e12_dedup_check", oracle(f"SELECT clause_type, count(*) AS n, count(DISTINCT {sql_hash('concat(clause_type, chr(124), chr(124), text)')}) AS n_distinct FROM v_clause GROUP BY 1"))
def e12(spark, sf_dir):
    return evaluation.dedup_check(view(spark, sf_dir, "v_clause"))


@register("e13_run_results", oracle(f"""WITH {FOUND} SELECT 'missing' AS domain, count(*) AS n_cases, count(*) FILTER (found = expected) AS n_passed, round(avg(CASE WHEN found = expected THEN 1.0::DOUBLE ELSE 0 END), 9) AS pass_rate FROM ev
   UNION ALL SELECT 'labels', count(*), count(*) FILTER (quality = toxic), round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 9) FROM labels"""))
def e13(spark, sf_dir):
    missing = _evaluated(spark, sf_dir).select(evaluation.same_set(F.col("found"), F.col("expected")).alias("passed"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("quality") == F.col("toxic")).alias("passed"))
    return evaluation.run_results({"missing": missing, "labels": labels}).withColumn("pass_rate", F.round("pass_rate", 9))


@register("x1_tumbling_counts", oracle("SELECT date_trunc('hour', event_time) AS window_start, date_trunc('hour', event_time) + INTERVAL 1 HOUR AS window_end, action, count(*) AS n FROM v_audit_event GROUP BY 1, 2, 3"))
def x1(spark, sf_dir):
    return streams.action_counts(view(spark, sf_dir, "v_audit_event"))


@register("x1_sliding_counts", oracle("SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, action, count(*) AS n FROM (SELECT action, unnest([time_bucket(INTERVAL 30 MINUTE, event_time), time_bucket(INTERVAL 30 MINUTE, event_time) - INTERVAL 30 MINUTE]) AS w FROM v_audit_event) AS x GROUP BY 1, 2, 3"))
def x1_sliding(spark, sf_dir):
    return streams.action_counts(view(spark, sf_dir, "v_audit_event"), size="1 hour", slide="30 minutes")


@register(
    "x1_session_counts",
    oracle("""SELECT job_id, min(event_time) AS session_start, max(event_time) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY event_time, audit_id) AS s FROM (
        SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY job_id ORDER BY event_time, audit_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM v_audit_event) AS x) AS y GROUP BY job_id, s"""),
)
def x1_sessions(spark, sf_dir):
    return streams.session_counts(view(spark, sf_dir, "v_audit_event"))


@register("x2_new_documents", oracle(f"SELECT DISTINCT document % 50 AS document_id, {sql_hash('text')} AS content_hash FROM v_page"))
def x2(spark, sf_dir):
    uploads = view(spark, sf_dir, "v_page").select((F.col("document") % 50).alias("document_id"), "text", F.lit("2024-01-01").cast("timestamp").alias("event_time"))
    return streams.new_documents(uploads).select("document_id", "content_hash")


def _requests(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


ADMISSIONS = """WITH RECURSIVE q AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS request_id, epoch_us(ts) / 1e6 AS "at", row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS r FROM events),
    s AS (SELECT key, request_id, "at", r, ["at"] AS times, true AS accepted FROM q WHERE r = 1
      UNION ALL SELECT key, request_id, "at", r, CASE WHEN len(held) < 2 THEN list_append(held, "at") ELSE held END, len(held) < 2
      FROM (SELECT q.*, list_filter(s.times, lambda t: q."at" - t <= 86400.0) AS held FROM s JOIN q ON q.key = s.key AND q.r = s.r + 1) AS x)
    SELECT key, request_id, "at", accepted FROM s"""


@register("x3_admissions", ADMISSIONS)
def x3(spark, sf_dir):
    return streams.admissions(_requests(spark, sf_dir), most=2, seconds=86400.0)


@register("x3_window_load", "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS request_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6 RANGE BETWEEN 86400.0 PRECEDING AND CURRENT ROW) AS load FROM events")
def x3_load(spark, sf_dir):
    return streams.window_load(_requests(spark, sf_dir), seconds=86400.0).select("key", "request_id", "load")


@register("x5_enriched", oracle("SELECT audit_id, action, c_mktsegment FROM v_audit_event LEFT JOIN customer ON job_id = c_custkey"))
def x5(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("job_id"), "c_mktsegment")
    return streams.enriched(view(spark, sf_dir, "v_audit_event"), c, ["job_id"]).select("audit_id", "action", "c_mktsegment")


@register("u1_hashed_embeddings")
def u1(spark, sf_dir):
    return hooks.with_embeddings(view(spark, sf_dir, "v_clause").select("clause_id", "text")).select("clause_id", "embedding")


@register("u3_annotations", oracle("SELECT clause_id, length(text) AS n_chars FROM v_clause"))
def u3(spark, sf_dir):
    def annotator():
        return lambda texts: [f'{{"n_chars": {len(t)}}}' for t in texts]

    return hooks.annotate(view(spark, sf_dir, "v_clause").select("clause_id", "text"), annotator, "n_chars bigint").select("clause_id", F.col("annotation.n_chars").alias("n_chars"))


@register("g1_same_clause_counts", oracle(f"WITH {SAME} SELECT src % 50 AS contract_id, count(*) AS n FROM same GROUP BY 1"))
def g1_counts(spark, sf_dir):
    return dashboards.count_by(_same(spark, sf_dir).withColumn("contract_id", F.col("src") % 50), "contract_id")


# Nested results as lists of texts, which SQL can make too. Of clauses and flags that share an id the least row stands for all.
_ONE_CLAUSE = "one AS (SELECT contract_id, clause_id, clause_type, text FROM (SELECT *, row_number() OVER (PARTITION BY clause_id ORDER BY clause_type, text) AS u FROM v_clause) AS x WHERE u = 1)"
_ONE_FLAG = "fl AS (SELECT risk_flag_id, contract_id, category, severity, CASE WHEN page_start % 5 <> 0 THEN clause_id END AS clause_id FROM (SELECT *, row_number() OVER (PARTITION BY risk_flag_id ORDER BY severity, category) AS u FROM v_risk_flag) AS x WHERE u = 1)"


def _one_clause(spark, sf_dir):
    rows = view(spark, sf_dir, "v_clause").groupBy("contract_id", "clause_id").agg(F.min(F.struct("clause_type", "text")).alias("m"))
    return rows.select("contract_id", "clause_id", "m.*")


def _one_flag(spark, sf_dir):
    rows = view(spark, sf_dir, "v_risk_flag").groupBy("risk_flag_id", "contract_id", "clause_id", "page_start").agg(F.min(F.struct("severity", "category")).alias("m"))
    return rows.select("risk_flag_id", "contract_id", F.when(F.col("page_start") % 5 != 0, F.col("clause_id")).alias("clause_id"), "m.*", F.lit(0.5).alias("confidence"))


def _listed(column: str, *fields: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws("|", *[x[f] for f in fields])), ";")


@register(
    "w9_brief_inputs_lists",
    oracle("""SELECT c.contract_id AS document_id, c.document_type, coalesce(a.clauses, '') AS clauses, coalesce(f.flags, '') AS flags FROM v_contract AS c
      LEFT JOIN (SELECT contract_id, string_agg(concat(clause_id, '|', clause_type, '|', text), ';' ORDER BY clause_id, clause_type, text) AS clauses FROM v_clause GROUP BY 1) AS a USING (contract_id)
      LEFT JOIN (SELECT contract_id, string_agg(concat(risk_flag_id, '|', severity), ';' ORDER BY risk_flag_id, severity) AS flags FROM v_risk_flag GROUP BY 1) AS f USING (contract_id)"""),
)
def w9_lists(spark, sf_dir):
    out = w9(spark, sf_dir)
    return out.select("document_id", "document_type", _listed("clauses", "clause_id", "clause_type", "text").alias("clauses"), _listed("flags", "risk_flag_id", "severity").alias("flags"))


@register(
    "w13_high_risk_rows",
    oracle(f"WITH {_ONE_CLAUSE}, {_ONE_FLAG} SELECT fl.contract_id, fl.clause_id, one.clause_type, fl.category, one.text AS preview FROM fl LEFT JOIN one ON fl.clause_id = one.clause_id WHERE fl.severity = 'high'"),
)
def w13_rows(spark, sf_dir):
    out = workflow.high_risk_details(_one_flag(spark, sf_dir), _one_clause(spark, sf_dir))
    return out.select("contract_id", F.explode("high_risk").alias("h")).select("contract_id", "h.*")


@register(
    "b7_document_detail_lists",
    oracle(f"""WITH {_ONE_CLAUSE}, {_ONE_FLAG},
      a AS (SELECT one.contract_id, string_agg(concat(one.clause_id, '|', one.clause_type, '|', one.text, '|', coalesce(fl.category || '/' || fl.severity, '')), ';' ORDER BY one.clause_id) AS clauses FROM one LEFT JOIN fl ON fl.clause_id = one.clause_id GROUP BY 1),
      d AS (SELECT contract_id, string_agg(concat(category, '/', severity), ';' ORDER BY category, severity) AS document_flags FROM fl WHERE clause_id IS NULL GROUP BY 1)
      SELECT c.contract_id, c.contract_name, c.status, a.clauses, d.document_flags FROM v_contract AS c LEFT JOIN a USING (contract_id) LEFT JOIN d USING (contract_id)"""),
)
def b7_lists(spark, sf_dir):
    out = dashboards.document_detail(view(spark, sf_dir, "v_contract"), _one_clause(spark, sf_dir), _one_flag(spark, sf_dir))
    flags = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["category"], F.lit("/"), x["severity"])), ";")
    none = F.array().cast("array<struct<category:string,severity:string,confidence:double>>")
    each = F.transform("clauses", lambda x: F.concat_ws("|", x["clause_id"], x["clause_type"], x["text"], flags(F.coalesce(x["flags"], none))))
    return out.select("contract_id", "contract_name", "status", F.array_join(each, ";").alias("clauses"), flags(F.col("document_flags")).alias("document_flags"))


@register("v7_memory_window", oracle("SELECT document_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY turn DESC) AS r FROM v_chat WHERE status = 'answered') AS x WHERE r <= 6"))
@register("v7_memory_window_6", oracle("SELECT document_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY turn DESC) AS r FROM v_chat WHERE status = 'answered') AS x WHERE r <= 6"))
def v7_six(spark, sf_dir):
    return history.memory_window(view(spark, sf_dir, "v_chat")).select("document_id", "turn")
