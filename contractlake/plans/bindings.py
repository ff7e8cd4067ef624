"""How the given tables play the roles of contracts, clauses, standards, logs and chats.

Each view is one SQL text that both Spark and the checking engine run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_contract": """
SELECT o_orderkey AS contract_id, concat('contract_', CAST(o_orderkey AS VARCHAR(20))) AS contract_name,
       o_custkey AS counterparty_id, c_name AS counterparty, c_nationkey AS org_profile_id, n_regionkey AS jurisdiction_id,
       n_regionkey % 2 AS customer_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'outsourcing' WHEN '2-HIGH' THEN 'service' WHEN '3-MEDIUM' THEN 'supply'
            WHEN '4-NOT SPECIFIED' THEN 'maintenance' ELSE 'license agreement' END AS document_type,
       CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'awaiting_review' ELSE 'processing' END AS status,
       o_totalprice AS monetary_value, o_orderdate AS effective_date
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_clause": """
SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS clause_id,
       l_orderkey AS contract_id, l_linenumber AS page_start, l_suppkey AS party_id,
       CASE l_partkey % 8 WHEN 0 THEN 'termination' WHEN 1 THEN 'liability_cap' WHEN 2 THEN 'confidentiality' WHEN 3 THEN 'governing_law'
            WHEN 4 THEN 'indemnification' WHEN 5 THEN 'payment' WHEN 6 THEN 'warranty' ELSE 'renewal' END AS clause_type,
       CASE WHEN l_partkey % 8 = 1 AND l_returnflag = 'R' THEN 'The supplier accepts Unlimited Liability here.'
            WHEN l_partkey % 8 = 7 AND l_returnflag = 'A' THEN concat('The term shall automatically renew for (', CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ') months.')
            ELSE concat('Notice of ', CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), CASE l_suppkey % 3 WHEN 0 THEN ' days' WHEN 1 THEN ' months' ELSE ' year' END, ' applies.') END AS text,
       1.0 - 5.0 * l_discount AS confidence,
       CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS severity
FROM lineitem""",
    "v_knowledge_reference": """
SELECT p_partkey AS knowledge_reference_id,
       CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 2 ELSE NULL END AS customer_id,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 25 END AS org_profile_id,
       CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 3 ELSE NULL END AS business_unit_id,
       CASE WHEN p_partkey % 6 = 0 THEN p_partkey % 5 ELSE NULL END AS jurisdiction_id,
       CASE WHEN p_partkey % 7 = 0 THEN 'service' WHEN p_partkey % 7 = 1 THEN 'supply' ELSE NULL END AS document_type,
       CASE (p_partkey + p_size) % 8 WHEN 0 THEN 'termination' WHEN 1 THEN 'liability_cap' WHEN 2 THEN 'confidentiality' WHEN 3 THEN 'governing_law'
            WHEN 4 THEN 'indemnification' WHEN 5 THEN 'payment' WHEN 6 THEN 'warranty' ELSE 'audit_rights' END AS clause_type,
       p_name AS reference_text, p_size AS version,
       CASE WHEN p_size % 10 = 0 THEN 'unapproved' ELSE 'approved' END AS approval_status,
       CASE WHEN p_partkey % 13 = 0 THEN 'risk_taxonomy' ELSE 'approved_clause' END AS source_kind,
       p_partkey % 17 = 0 AS is_mandatory, p_partkey % 19 = 0 AS is_prohibited,
       CASE WHEN p_size % 7 = 0 THEN DATE '2100-01-01' ELSE DATE '1990-01-01' END AS effective_date,
       CASE WHEN p_size % 11 = 0 THEN DATE '2000-01-01' ELSE NULL END AS expiry_date
FROM part""",
    # A context for each org profile, contract type and clause type that occur together.
    "v_context": """
SELECT DISTINCT concat(CAST(c.org_profile_id AS VARCHAR(20)), '/', c.document_type, '/', l.clause_type) AS context_id,
       c.org_profile_id, c.jurisdiction_id, c.customer_id, c.org_profile_id % 3 AS business_unit_id, c.document_type, l.clause_type
FROM v_contract AS c JOIN v_clause AS l ON c.contract_id = l.contract_id""",
    "v_audit_event": """
SELECT event_id AS audit_id, user_id AS job_id, ts AS event_time,
       CASE event_type WHEN 'signup' THEN 'query_received' WHEN 'view' THEN 'retrieval_completed' WHEN 'click' THEN 'draft_answer_generated'
            WHEN 'purchase' THEN 'review_approved' ELSE 'answer_rejected' END AS action, value, props AS details
FROM events""",
    "v_chat": """
SELECT conv_id AS document_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN next_text ELSE NULL END AS answer,
       CASE WHEN next_role = 'assistant' THEN 'answered' ELSE 'evidence_rejected' END AS status
FROM (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) AS x
WHERE role = 'user'""",
    "v_vector": """
SELECT vec_id AS clause_id, vec_id % 50 AS contract_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL""",
    "v_page": """
SELECT doc_id AS document, text FROM documents WHERE text IS NOT NULL""",
    "v_risk_flag": """
SELECT concat('f-', clause_id) AS risk_flag_id, clause_id, contract_id AS document_id, contract_id, clause_type AS category, severity, confidence,
       CASE WHEN party_id % 2 = 0 THEN 'org_profile' ELSE 'llm_generated' END AS fallback_source, text, page_start
FROM v_clause""",
    # Decisions on approval steps: one order is one brief, its lines are its steps.
    "v_step": """
SELECT l_orderkey AS brief_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS sequence,
       CASE l_suppkey % 4 WHEN 0 THEN 'reviewer' WHEN 1 THEN 'senior_counsel' WHEN 2 THEN 'business_head' ELSE 'clo' END AS required_role,
       CASE WHEN l_partkey % 11 = 0 THEN 'reject' WHEN l_partkey % 13 = 0 THEN 'send_back' WHEN l_partkey % 5 = 0 THEN NULL
            WHEN l_partkey % 7 = 0 THEN 'approve_with_changes' ELSE 'approve' END AS decision
FROM lineitem""",
    # Summaries of contracts: one customer is one document, its orders are its versions.
    "v_version": """
SELECT o_custkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version_number,
       concat('summary of ', CAST(o_orderkey AS VARCHAR(20))) AS summary_text, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'editor' END AS edited_by,
       o_orderkey % 3 = 0 AS is_ai_generated, 'draft' AS approval_status, o_orderdate AS created_at
FROM orders""",
    "v_level_change": """
SELECT user_id AS document_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'manual' ELSE 'automatic' END AS source,
       CASE event_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'highly_confidential' END AS new_level
FROM events""",
    # Questions: whole documents with a lead that names a style or a topic.
    "v_whole_question": """
SELECT doc_id AS question_id, concat(CASE doc_id % 12
         WHEN 0 THEN 'Summarize the contract ' WHEN 1 THEN 'Which vendor shares the same clause under a judgment where Acme Corp is the vendor ' WHEN 2 THEN 'Why does section 4 say '
         WHEN 3 THEN 'explain the liability cap ' WHEN 4 THEN 'indemnity with another contract ' WHEN 5 THEN 'governing law ' WHEN 6 THEN 'See Smith v. Jones on ' WHEN 7 THEN 'summary please '
         WHEN 8 THEN 'what happens if termination ' WHEN 9 THEN 'quote "the exact words" ' WHEN 10 THEN 'DROP the index and Explain ' ELSE '' END, text) AS question
FROM documents WHERE text IS NOT NULL""",
    # Texts with words of the rules: clause texts and what the part's numbers imply.
    "v_classified": """
SELECT p_partkey AS document_id, concat(CASE p_partkey % 9 WHEN 0 THEN 'Strictly  Confidential. ' WHEN 1 THEN 'confidential ' WHEN 2 THEN 'INTERNAL USE ONLY ' WHEN 3 THEN 'A public filing. ' ELSE '' END,
         p_name, CASE p_partkey % 7 WHEN 0 THEN ' the merger and its valuation' WHEN 1 THEN ' unit price list' WHEN 2 THEN ' personal data and salary' WHEN 3 THEN ' Board Resolution' ELSE '' END) AS text,
       CASE WHEN p_partkey % 10 = 4 THEN 'NDA' ELSE 'supply' END AS document_type,
       CASE p_size % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' WHEN 3 THEN 'highly_confidential' ELSE NULL END AS model_level,
       p_size / 50.0 AS model_confidence, (p_partkey % 10) / 10.0 AS ocr_ratio
FROM part""",
}


def _needed(text: str) -> list[str]:
    """The views that a text names, and those that they name, in the order of their definition."""
    found: set[str] = set()
    todo = [text]
    while todo:
        names = {v for v in VIEWS if re.search(rf"\b{v}\b", todo[-1])} - found
        todo.pop()
        found |= names
        todo += [VIEWS[v] for v in names]
    return [v for v in VIEWS if v in found]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of `sf_dir`; only the tables it names are opened."""
    wanted = [*_needed(VIEWS[name]), name]
    text = " ".join(VIEWS[v] for v in wanted)
    frames: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    for v in wanted:
        named = {n: df for n, df in frames.items() if re.search(rf"\b{n}\b", VIEWS[v])}
        body = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(map(re.escape, named))})\b", r"\1\2{\3}", VIEWS[v]) if named else VIEWS[v]
        frames[v] = spark.sql(body, **named)
    return frames[name]


def oracle(text: str) -> str:
    """The text with the views that it names in front."""
    names = _needed(text)
    if not names:
        return text
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    body = text.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads} {body}"
