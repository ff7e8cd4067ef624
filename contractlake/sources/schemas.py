"""Declared schemas of the operational tables and reference files."""

from __future__ import annotations

RECORD = "array<struct<name:string,role:string>>"

TABLES = {
    "customer": "customer_id string, code string, name string, is_active boolean, created_at timestamp",
    "jurisdiction": "jurisdiction_id string, code string, name string, data_localization_required boolean",
    "org_profile": "profile_id string, customer_id string, name string, jurisdiction_defaults map<string,string>,"
    " required_clause_checklist map<string,array<string>>, risk_threshold_overrides map<string,string>",
    "business_unit": "business_unit_id string, org_profile_id string, code string, name string",
    "document": f"document_id string, org_profile_id string, document_type string, counterparty string, geography string, confidentiality_level string,"
    f" confidentiality_confidence double, parties {RECORD}, effective_date string, end_date string, monetary_value double,"
    " governing_law_country string, status string, job_id string, contract_id string, chat_cleared_at timestamp",
    "clause": "clause_id string, document_id string, clause_type string, extracted_text string, page_reference string, party string,"
    " confidence double, content_hash string, version int",
    "risk_flag": "risk_flag_id string, clause_id string, document_id string, category string, severity string, confidence double,"
    " deviation_score double, confidence_breakdown struct<ocr_quality:double,retrieval_relevance:double,llm_confidence:double>,"
    " standards_evidence string, applicable_rule_source string, assigned_role string, reviewer_status string",
    "playbook_entry": "playbook_entry_id string, risk_flag_id string, fallback_positions array<string>, fallback_source string, suggested_redline string",
    "review_action": "review_action_id string, document_id string, clause_id string, risk_flag_id string, role string, action string, timestamp timestamp",
    "audit_log": "audit_id string, document_id string, stage string, actor string, action string, details string, timestamp timestamp",
    "summary_version": "summary_version_id string, document_id string, version_number int, summary_text string, edited_by string,"
    " is_ai_generated boolean, approval_status string, restored_from_version int, created_at timestamp",
    "confidentiality_override": "override_id string, document_id string, previous_level string, new_level string, source string, changed_by string, created_at timestamp",
    "knowledge_reference": "knowledge_reference_id string, customer_id string, org_profile_id string, business_unit_id string, jurisdiction_id string,"
    " document_type string, clause_type string, title string, reference_text string, source_kind string, approval_status string,"
    " is_mandatory boolean, is_prohibited boolean, effective_date timestamp, expiry_date timestamp, version int",
    "decision_brief": "decision_brief_id string, document_id string, version_number int, sections map<string,string>, recommendation string,"
    " status string, superseded_by_version int, created_at timestamp",
    "approval_step": "approval_step_id string, decision_brief_id string, sequence int, required_role string, status string, decided_by string, decided_at timestamp",
    "chat_message": "chat_message_id string, document_id string, question string, answer string, citations array<string>, status string,"
    " retrieved_contexts array<string>, route string, created_at timestamp",
    "evaluation_run": "run_id string, status string, metrics map<string,double>, case_counts map<string,int>, duration_seconds double, started_at timestamp",
    "evaluation_case_result": "case_id string, run_id string, domain string, case_label string, passed boolean, scores map<string,double>, detail string",
}

APPROVED_CLAUSES = (
    "clause_type string, title string, approved_text string, business_unit string, jurisdiction string, approval_date string, owner string, notes string"
)
POLICIES = "policy_id string, title string, category string, summary string, applies_to array<string>, version string, approved_date string, owner string"
RISK_TAXONOMY = "risk_category string, severity string, description string, typical_clause_types string, recommended_reviewer_action string"
CHAT_LOG = (
    "question string, answer string, contexts array<string>, citations array<string>, reference_answer string, reference_contexts array<string>,"
    " document_id string, organization string, jurisdiction string, expected_standard_source string, logged_at timestamp"
)
EVENTS = {
    "review_action": TABLES["review_action"],
    "audit_log": TABLES["audit_log"],
    "reviewer_decision": "decision_id string, contract_id string, decision string, role string, comments string, timestamp timestamp",
    "chat_turn": TABLES["chat_message"],
    "terminal_state": "job_id string, status string, detail string, timestamp timestamp",
}
