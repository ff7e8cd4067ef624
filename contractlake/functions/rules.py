"""Vocabularies of the rules: data that every operator takes as a parameter."""

from __future__ import annotations

# These lists and patterns define the results, and are stated as they are.

#: Clause types that may occur more than once in a document.
REPEATABLE_TYPES = ["payment", "service_levels", "warranty"]
AUTO_RENEWAL = r"(?i)\b(automatically renew|auto-renew|automatic renewal|shall renew unless|evergreen)\b"
UNLIMITED_LIABILITY = (
    r"(?i)\b(unlimited liability|no limit(?:ation)? (?:on|of) liability|liability shall not be limited|uncapped liability)\b"
)
LIABILITY_TYPES = ["limitation_of_liability", "liability_cap", "liability"]
VALUE_THRESHOLD = 10_000_000.0

EXPECTED_CLAUSES = {
    "outsourcing": ["termination", "liability_cap", "confidentiality", "indemnification", "governing_law"],
    "service": ["termination", "liability_cap", "confidentiality", "governing_law"],
    "supply": ["termination", "liability_cap", "confidentiality", "governing_law"],
    "maintenance": ["termination", "liability_cap", "confidentiality", "governing_law"],
    "license agreement": ["termination", "confidentiality", "governing_law"],
    "non-compete/solicit": ["confidentiality", "termination", "governing_law"],
}
DEFAULT_EXPECTED = ["termination", "liability_cap", "confidentiality", "governing_law"]

#: Levels from least to most sensitive; labels in the order in which they are tried.
LEVELS = ["public", "internal", "confidential", "highly_confidential"]
LEVEL_LABELS = [
    (r"(?i)\bstrictly\s+confidential\b", "highly_confidential"),
    (r"(?i)\bconfidential\b", "confidential"),
    (r"(?i)\binternal\s+use\s+only\b", "internal"),
    (r"(?i)\bpublic\s+filing\b", "public"),
]
SIGNALS = {
    "m&a": ("highly_confidential", ["merger", "acquisition", "m&a", "amalgamation"]),
    "valuation": ("highly_confidential", ["valuation", "fair market value", "enterprise value"]),
    "trade_secrets": ("highly_confidential", ["trade secret", "proprietary technology", "proprietary process"]),
    "board_materials": ("highly_confidential", ["board materials", "board resolution", "board of directors meeting"]),
    "tender_bid": ("confidential", ["tender", "bid submission", "request for proposal"]),
    "pricing": ("confidential", ["unit price", "pricing schedule", "detailed pricing"]),
    "personal_data": ("confidential", ["personal data", "personally identifiable information", "date of birth", "passport number"]),
    "salary": ("confidential", ["salary", "compensation package", "remuneration details"]),
    "financial_statements": ("confidential", ["balance sheet", "income statement", "financial statements", "profit and loss"]),
    "nda": ("confidential", ["non-disclosure agreement", "nondisclosure agreement"]),
    "data_processing": ("confidential", ["data processing agreement", "data processing terms", "processing of personal data"]),
}
NDA_TYPES = ["nda", "non-disclosure"]
ACCESS = {
    "highly_confidential": ["senior_counsel", "admin"],
    "confidential": ["reviewer", "senior_counsel", "admin"],
    "internal": ["reviewer", "senior_counsel", "admin"],
    "public": ["reviewer", "senior_counsel", "admin"],
}
SENIORITY = {"reviewer": 0, "senior_counsel": 1, "business_head": 2, "clo": 3, "admin": 4}

#: Standards levels, first match first, with the context fields that each needs.
STANDARD_LEVELS = [
    ("business_unit_jurisdiction_document_type", ["business_unit_id", "jurisdiction_id"]),
    ("business_unit_document_type", ["business_unit_id"]),
    ("organization_jurisdiction_document_type", ["org_profile_id", "jurisdiction_id"]),
    ("organization_document_type", ["org_profile_id"]),
    ("customer_jurisdiction_document_type", ["customer_id", "jurisdiction_id"]),
    ("customer_document_type", ["customer_id"]),
    ("jurisdiction_only", ["jurisdiction_id"]),
    ("customer_group_fallback", []),
]
#: Of these fields a standard may hold none that its level does not ask for.
NARROWING_FIELDS = ["business_unit_id", "jurisdiction_id"]

SUPPLIER_ROLES = [
    "vendor", "supplier", "licensor", "lessor", "contractor", "consultant",
    "service provider", "provider", "seller", "distributor", "reseller",
]

ALPHA_BY_STYLE = {"exact_match": 0.2, "balanced": 0.4, "semantic": 0.7}
EXACT_PATTERNS = [r'"[^"]{3,}"', r"(?i)\bsection\s+\d", r"(?i)\bclause\s+\d", r"(?i)\b(art\.|article)\s+\d", r"\bv\.\s+[A-Z]"]
SEMANTIC_PHRASES = [
    "why", "explain", "what happens if", "summarize", "summarise", "in plain english",
    "does this mean", "how does", "what if", "implications", "risk of",
]
WHOLE_DOCUMENT_PHRASES = [
    "summarize it", "summarise it", "summarize this", "summarise this",
    "summarize the document", "summarise the document", "summarize the contract",
    "summarise the contract", "summarize the agreement", "summarise the agreement",
    "give me a summary", "overview of this", "overview of the document",
    "overview of the contract", "key terms of this", "key points of this",
    "walk me through this", "what does this contract say", "what does this say overall",
]
GRAPH_PHRASES = [
    "same clause", "another contract", "other contract", "conflict", "conflicts",
    "judgment", "judgement", "precedent", "interpreted by", "relationship between",
    "across contracts", "multiple contracts", "linked to", "connected to",
    "cites", "citing", "who else", "vendor", "counterparty", "party to",
]
TOPIC_PHRASES = [
    "indemnification", "indemnity", "termination", "confidentiality", "liability",
    "non-compete", "non compete", "warranty", "warranties", "governing law", "limitation of liability",
]
TOPICS = [
    ("termination", ["termination", "terminate"]),
    ("liability_cap", ["liability cap", "limitation of liability", "cap on liability", "liability limit"]),
    ("confidentiality", ["confidentiality", "non-disclosure", "nondisclosure"]),
    ("governing_law", ["governing law", "applicable law", "jurisdiction clause"]),
    ("indemnification", ["indemnification", "indemnity", "indemnify"]),
]
VENDOR = r"([A-Z][A-Za-z0-9&.,'\-]*(?:\s+[A-Z][A-Za-z0-9&.,'\-]*)*)\s+(?:is|as)\s+the\s+vendor"
MUTATING = r"(?i)\b(CREATE|MERGE|DELETE|DETACH|SET|REMOVE|DROP|CALL\s+apoc\.|LOAD\s+CSV)\b"

CONFIDENCE_WEIGHTS = {"ocr_quality": 0.3, "retrieval_relevance": 0.3, "llm_confidence": 0.4}
CONFIDENCE_LABELS = {
    "ocr_quality": "source OCR quality", "retrieval_relevance": "retrieval relevance", "llm_confidence": "model self-reported confidence",
}
UPLOAD_TYPES = {
    "pdf": ["application/pdf"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
}
MAX_UPLOAD_BYTES, MAX_UPLOAD_PAGES, MAX_QUESTION, MAX_COMMENT = 50 * 1024 * 1024, 300, 2000, 4000

# What a heading and a duration look like, and why a step stands in an approval chain.
HEADING = r"^[A-Z0-9][A-Za-z0-9 ,.:\-()]{2,80}$"
DURATION = r"(?i)\b\(?([0-9]+)\)?\s*(day|days|month|months|year|years)\b"
REASONS = {
    "reviewer": "first reviewer",
    "senior_counsel": "second-level legal approval",
    "high_risk": "high/critical risk flag present",
    "over_value": "contract value >= ",
    "secret": "highly confidential document",
    "clo": "organization policy explicitly requires CLO approval",
    "policy": "organization approval policy",
}
