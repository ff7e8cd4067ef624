"""Queries on the clause graph, conflicts, rules, standards, confidentiality and scores (G, J, K, S, C, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contractlake.functions import rules
from contractlake.operators import compliance, graph, portfolio, scoring, sensitivity, standards
from contractlake.plans.bindings import oracle, view
from contractlake.plans.registry import register
from contractlake.plans.text_queries import sql_cosine

DAYS = """terms AS (
  SELECT clause_id, contract_id, clause_type, list_max(list_transform(list_zip(regexp_extract_all(text, '\\b\\(?([0-9]+)\\)?\\s*(day|days|month|months|year|years)\\b', 1, 'i'),
      regexp_extract_all(lower(text), '\\b\\(?([0-9]+)\\)?\\s*(day|days|month|months|year|years)\\b', 2)),
      lambda z: CAST(z[1] AS BIGINT) * CASE WHEN z[2] LIKE 'day%' THEN 1 WHEN z[2] LIKE 'month%' THEN 30 ELSE 365 END)) AS longest FROM v_clause)"""
SCOPED = "scoped AS (SELECT t.*, c.counterparty_id FROM terms AS t JOIN v_contract AS c USING (contract_id) WHERE longest IS NOT NULL)"
PAIRS = """pairs AS (
  SELECT a.counterparty_id, a.clause_type, a.contract_id AS contract_a, a.clause_id AS clause_a, a.longest AS days_a,
    b.contract_id AS contract_b, b.clause_id AS clause_b, b.longest AS days_b, abs(a.longest - b.longest) AS delta_days
  FROM scoped AS a JOIN scoped AS b ON a.counterparty_id = b.counterparty_id AND a.clause_type = b.clause_type AND a.contract_id <> b.contract_id
    AND a.clause_id < b.clause_id AND abs(a.longest - b.longest) >= 15)"""


def _scoped(spark, sf_dir):
    return view(spark, sf_dir, "v_clause").join(view(spark, sf_dir, "v_contract").select("contract_id", "counterparty_id"), "contract_id")


def _conflicts(spark, sf_dir):
    return portfolio.conflicting_pairs(_scoped(spark, sf_dir), scope="counterparty_id")


@register("j1_duration_terms", oracle(f"WITH {DAYS} SELECT clause_id, contract_id, longest FROM terms"))
def j1(spark, sf_dir):
    return portfolio.with_term(view(spark, sf_dir, "v_clause")).select("clause_id", "contract_id", F.col("days").alias("longest"))


@register("j2_conflicting_pairs", oracle(f"WITH {DAYS}, {SCOPED}, {PAIRS} SELECT * FROM pairs"))
def j2(spark, sf_dir):
    return _conflicts(spark, sf_dir)


@register("j3_scopes_of_several", oracle("SELECT contract_id, counterparty_id FROM (SELECT *, count(*) OVER (PARTITION BY org_profile_id, counterparty_id) AS n FROM v_contract) AS x WHERE n >= 2"))
def j3(spark, sf_dir):
    return portfolio.scopes_of_several(view(spark, sf_dir, "v_contract"), ["org_profile_id", "counterparty_id"]).select("contract_id", "counterparty_id")


@register("j4_term_spread", oracle(f"WITH {DAYS}, {SCOPED} SELECT counterparty_id, clause_type, min(longest) AS min_days, max(longest) AS max_days, max(longest) - min(longest) AS spread_days, count(DISTINCT contract_id) AS n_contracts FROM scoped GROUP BY 1, 2"))
def j4(spark, sf_dir):
    return portfolio.term_spread(view(spark, sf_dir, "v_clause"), scope="counterparty_id", contracts=view(spark, sf_dir, "v_contract"))


SAME = f"""sims AS (SELECT a.clause_id AS src, b.clause_id AS dst, round({sql_cosine('a.embedding', 'b.embedding')}, 9) AS similarity
  FROM v_vector AS a JOIN v_vector AS b ON a.clause_id <> b.clause_id AND a.contract_id <> b.contract_id),
same AS (SELECT src, dst, similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS r FROM sims WHERE similarity >= 0.4) AS x WHERE r <= 3)"""


def _same(spark, sf_dir):
    return graph.same_clause_edges(view(spark, sf_dir, "v_vector"), least=0.40, blocked=True)


@register("g1_same_clause_edges", oracle(f"WITH {SAME} SELECT src, dst, round(similarity, 6) AS similarity FROM same"))
def g1(spark, sf_dir):
    return _same(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@register("g2_conflict_flags", oracle(f"WITH {DAYS}, {SCOPED}, {PAIRS} SELECT clause_a AS clause_id, 'conflicting_terms' AS category, 'high' AS severity, 0.85 AS confidence, concat('terms differ by ', delta_days, ' days') AS reason FROM (SELECT clause_a, clause_b, min(delta_days) AS delta_days FROM pairs GROUP BY 1, 2) AS x"))
def g2(spark, sf_dir):
    return graph.conflict_flags(graph.conflict_edges(_conflicts(spark, sf_dir)))


def _cited(spark, sf_dir):
    """Citations of clauses: one for each divisor of the vector's id."""
    v = view(spark, sf_dir, "v_vector")
    cite = lambda k: F.when(F.col("clause_id") % k == 0, F.struct(F.lit(f"J{k}").alias("citation"), F.when(F.col("clause_id") % 2 == 0, f"court {k}").alias("court")))
    return v.select("clause_id", F.array_compact(F.array(*[cite(k) for k in (2, 3, 5)])).alias("judgment_citations"), F.col("clause_id").alias("seq"))


CITED = "cited AS (SELECT clause_id, 'J2' AS citation FROM v_vector WHERE clause_id % 2 = 0 UNION ALL SELECT clause_id, 'J3' FROM v_vector WHERE clause_id % 3 = 0 UNION ALL SELECT clause_id, 'J5' FROM v_vector WHERE clause_id % 5 = 0)"


@register("g3_judgment_edges", oracle(f"WITH {CITED} SELECT clause_id, citation, CASE citation WHEN 'J2' THEN 'court 2' WHEN 'J3' THEN 'court 3' ELSE 'court 5' END AS court FROM cited"))
def g3(spark, sf_dir):
    nodes, edges = graph.judgment_graph(_cited(spark, sf_dir))
    return edges.join(nodes, "citation").select("clause_id", "citation", "court")


@register(
    "g4_shared_interpretations",
    oracle(
        f"""WITH {SAME}, {CITED}, links AS (SELECT src, dst FROM same UNION SELECT dst, src FROM same),
        many AS (SELECT clause_id, list_sort(list(DISTINCT citation)) AS citations FROM cited GROUP BY 1 HAVING count(DISTINCT citation) >= 2)
        SELECT DISTINCT concat('V', a.contract_id % 7) AS vendor, a.contract_id, b.contract_id AS other_contract, a.clause_id, array_to_string(m.citations, ',') AS citations
        FROM v_vector AS a JOIN many AS m USING (clause_id) JOIN links ON a.clause_id = src JOIN v_vector AS b ON b.clause_id = dst WHERE a.contract_id <> b.contract_id
        ORDER BY vendor, contract_id, other_contract, clause_id LIMIT 25"""
    ),
)
def g4(spark, sf_dir):
    v = view(spark, sf_dir, "v_vector")
    contains = v.select("contract_id", "clause_id")
    vendors = contains.select("contract_id").distinct().withColumn("vendor", F.concat(F.lit("V"), F.col("contract_id") % 7))
    _, cited = graph.judgment_graph(_cited(spark, sf_dir))
    out = graph.shared_interpretations(vendors, contains, _same(spark, sf_dir), cited)
    return out.withColumn("citations", F.array_join("citations", ","))


@register("g5_clauses_of", oracle("SELECT clause_id, contract_id, clause_type FROM v_clause WHERE contract_id IN (SELECT contract_id FROM v_contract WHERE status = 'processing')"))
def g5(spark, sf_dir):
    return graph.clauses_of(view(spark, sf_dir, "v_contract").filter("status = 'processing'"), view(spark, sf_dir, "v_clause")).select("clause_id", "contract_id", "clause_type")


@register("g6_citation_edges", "SELECT DISTINCT event_id AS question_id, c AS clause_id FROM (SELECT event_id, unnest([event_id % 300, event_id % 7, 100000000]) AS c FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0) AS x WHERE c IN (SELECT vec_id FROM embeddings)")
def g6(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    answers = e.select(
        F.col("event_id").alias("question_id"), F.when(F.col("event_id") % 2 == 0, "graph").otherwise("hybrid").alias("route"),
        F.when(F.col("event_type") == "purchase", "approved").otherwise("rejected").alias("status"),
        F.array(F.col("event_id") % 300, F.col("event_id") % 7, F.lit(100000000).cast("long")).alias("cited"),
    )
    return graph.citation_edges(answers, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("clause_id"))).select("question_id", "clause_id")


@register("g7_two_hops", oracle("SELECT r_regionkey AS region, count(*) AS n_contracts FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN v_contract ON counterparty_id = c_custkey GROUP BY 1"))
def g7(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    edge = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    rows = graph.hop(read("region").select(F.col("r_regionkey").alias("region")), edge(read("nation"), "n_nationkey", "n_regionkey"), "region", "nation", direction="in")
    rows = graph.hop(rows, edge(read("customer"), "c_custkey", "c_nationkey"), "nation", "customer", direction="in")
    rows = graph.hop(rows, edge(view(spark, sf_dir, "v_contract"), "counterparty_id", "contract_id"), "customer", "contract")
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n_contracts"))


@register(
    "g7_linked_contracts",
    oracle("""WITH RECURSIVE links AS (SELECT DISTINCT contract_id AS c, split_part(clause_id, '-', 3) || '-' || split_part(clause_id, '-', 4) AS p FROM v_clause),
    walk AS (SELECT jurisdiction_id AS origin, contract_id AS c, 0 AS hops FROM v_contract WHERE monetary_value > 400000
      UNION SELECT origin, b.c, hops + 2 FROM walk JOIN links AS a ON a.c = walk.c JOIN links AS b ON b.p = a.p WHERE hops < 8)
    SELECT origin, c AS contract_id, min(hops) // 2 AS links FROM walk GROUP BY 1, 2"""),
)
def g7_linked(spark, sf_dir):
    """Contracts within four links of a large contract of a jurisdiction; contracts are linked by a part of the same supplier, through that part's node.

    Most parts of a supplier are in one contract: they link nothing, and are dropped before the walk. Contracts become names after that.
    """
    part = F.substring_index(F.substring_index("clause_id", "-", 4), "-", -2)  # its third and fourth number
    held = view(spark, sf_dir, "v_clause").select(F.col("contract_id").alias("src"), part.alias("dst"))
    edges = graph.shared_ends(held).select(F.concat(F.lit("c"), F.col("src").cast("string")).alias("src"), "dst")
    large = view(spark, sf_dir, "v_contract").filter("monetary_value > 400000")
    starts = large.select(F.col("jurisdiction_id").alias("origin"), F.concat(F.lit("c"), F.col("contract_id").cast("string")).alias("node"))
    found = graph.reachable(starts, edges, most=8, direction="both").filter(F.col("node").startswith("c"))
    return found.select("origin", F.substring("node", 2, 30).cast("long").alias("contract_id"), (F.col("hops") / 2).cast("long").alias("links"))


@register(
    "g8_contract_edges",
    oracle("""SELECT CAST(counterparty_id % 97 AS VARCHAR) AS src, 'PRODUCED' AS edge_type, CAST(contract_id AS VARCHAR) AS dst, CAST(NULL AS VARCHAR) AS role FROM v_contract WHERE contract_id % 2 = 0
      UNION ALL SELECT CAST(contract_id AS VARCHAR), 'HAS_VENDOR', counterparty, NULL FROM v_contract
      UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'HAS_PARTY', CAST(l_suppkey AS VARCHAR), arg_max(l_returnflag, concat(l_linenumber, lpad(CAST(l_partkey AS VARCHAR), 12, '0'), l_returnflag)) FROM lineitem GROUP BY l_orderkey, l_suppkey"""),
)
def g8(spark, sf_dir):
    c = view(spark, sf_dir, "v_contract")
    docs = c.select(F.col("contract_id").alias("document_id"), F.when(F.col("contract_id") % 2 == 0, F.col("counterparty_id") % 97).alias("job_id"), "contract_id", F.col("counterparty").alias("vendor"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seq = F.concat(F.col("l_linenumber").cast("string"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.col("l_returnflag"))
    return graph.contract_edges(docs, li.select(F.col("l_orderkey").alias("contract_id"), F.col("l_suppkey").alias("name"), F.col("l_returnflag").alias("role"), seq.alias("seq")))


@register("k1_duplicate_types", oracle("SELECT contract_id, clause_type, count(*) AS n, min(clause_id) AS first_clause FROM v_clause WHERE clause_type NOT IN ('payment', 'service_levels', 'warranty') GROUP BY 1, 2 HAVING count(*) > 1"))
def k1(spark, sf_dir):
    return compliance.duplicate_types(view(spark, sf_dir, "v_clause")).select("contract_id", "clause_type", "n", F.col("clause_ids")[0].alias("first_clause"))


@register("k2_auto_renewal", oracle(r"SELECT clause_id, contract_id, regexp_extract(text, '\b(automatically renew|auto-renew|automatic renewal|shall renew unless|evergreen)\b', 0, 'i') AS evidence FROM v_clause WHERE regexp_matches(text, '\b(automatically renew|auto-renew|automatic renewal|shall renew unless|evergreen)\b', 'i')"))
def k2(spark, sf_dir):
    return compliance.auto_renewal(view(spark, sf_dir, "v_clause")).select("clause_id", "contract_id", "evidence")


_UNLIMITED = r"\b(unlimited liability|no limit(?:ation)? (?:on|of) liability|liability shall not be limited|uncapped liability)\b"


@register("k3_unlimited_liability", oracle(f"SELECT clause_id, contract_id, regexp_extract(text, '{_UNLIMITED}', 0, 'i') AS evidence FROM v_clause WHERE clause_type IN ('limitation_of_liability', 'liability_cap', 'liability') AND regexp_matches(text, '{_UNLIMITED}', 'i')"))
def k3(spark, sf_dir):
    return compliance.unlimited_liability(view(spark, sf_dir, "v_clause")).select("clause_id", "contract_id", "evidence")


@register("k4_over_value", oracle("SELECT contract_id, monetary_value, CASE WHEN org_profile_id % 2 = 0 THEN 100000.0 ELSE 300000.0 END AS threshold FROM v_contract WHERE monetary_value >= CASE WHEN org_profile_id % 2 = 0 THEN 100000.0 ELSE 300000.0 END"))
def k4(spark, sf_dir):
    bar = F.when(F.col("org_profile_id") % 2 == 0, 100000.0).otherwise(300000.0)
    return compliance.over_value(view(spark, sf_dir, "v_contract"), bar).select("contract_id", "monetary_value", "threshold")


@register("k5_governing_law", oracle("SELECT contract_id, law AS governing_law_country, expected AS expected_country FROM (SELECT contract_id, CASE WHEN contract_id % 5 = 0 THEN NULL ELSE concat('R', contract_id % 3) END AS law, CASE WHEN org_profile_id % 4 = 0 THEN 'r1' ELSE concat('r', jurisdiction_id % 3) END AS expected FROM v_contract) AS x WHERE upper(law) <> upper(expected)"))
def k5(spark, sf_dir):
    c = view(spark, sf_dir, "v_contract").withColumn("governing_law_country", F.when(F.col("contract_id") % 5 != 0, F.concat(F.lit("R"), F.col("contract_id") % 3)))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    expected = n.select(F.col("n_nationkey").alias("org_profile_id"), F.when(F.col("n_nationkey") % 4 == 0, "r1").alias("override_country"), F.concat(F.lit("r"), F.col("n_regionkey") % 3).alias("default_country"))
    return compliance.governing_law(c, expected).select("contract_id", "governing_law_country", "expected_country")


EXPECTED = "expected AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, ts in rules.EXPECTED_CLAUSES.items() for t in ts) + ") AS v(document_type, clause_type))"


@register("k6_missing_clauses", oracle(f"WITH {EXPECTED} SELECT contract_id, e.clause_type FROM v_contract JOIN expected AS e USING (document_type) WHERE NOT EXISTS (SELECT 1 FROM v_clause AS l WHERE l.contract_id = v_contract.contract_id AND l.clause_type = e.clause_type)"))
def k6(spark, sf_dir):
    return compliance.missing_clauses(view(spark, sf_dir, "v_contract"), view(spark, sf_dir, "v_clause"))


AS_OF = "DATE '2001-08-01'"


def _as_of():
    return F.lit("2001-08-01").cast("date")


CANDIDATES = """cand AS (SELECT c.context_id, c.org_profile_id AS c_org, c.business_unit_id AS c_unit, c.jurisdiction_id AS c_jur, c.customer_id AS c_cust, c.document_type AS c_type, r.*
  FROM v_context AS c JOIN v_knowledge_reference AS r ON r.clause_type = c.clause_type AND (r.customer_id IS NULL OR r.customer_id = c.customer_id)
   AND (r.org_profile_id IS NULL OR r.org_profile_id = c.org_profile_id) AND (r.business_unit_id IS NULL OR r.business_unit_id = c.business_unit_id)
   AND (r.jurisdiction_id IS NULL OR r.jurisdiction_id = c.jurisdiction_id) AND (r.document_type IS NULL OR r.document_type = c.document_type)),
act AS (SELECT *, approval_status = 'approved' AND coalesce(expiry_date >= DATE '2001-08-01', true) AND coalesce(effective_date <= DATE '2001-08-01', true) AS active FROM cand)"""
RESOLVED = f"""{CANDIDATES},
lev AS (SELECT *, CASE WHEN NOT active THEN NULL
   WHEN business_unit_id = c_unit AND jurisdiction_id = c_jur THEN 1 WHEN business_unit_id = c_unit AND jurisdiction_id IS NULL THEN 2
   WHEN org_profile_id = c_org AND jurisdiction_id = c_jur AND business_unit_id IS NULL THEN 3 WHEN org_profile_id = c_org AND jurisdiction_id IS NULL AND business_unit_id IS NULL THEN 4
   WHEN customer_id = c_cust AND jurisdiction_id = c_jur AND business_unit_id IS NULL THEN 5 WHEN customer_id = c_cust AND jurisdiction_id IS NULL AND business_unit_id IS NULL THEN 6
   WHEN jurisdiction_id = c_jur AND business_unit_id IS NULL THEN 7 WHEN business_unit_id IS NULL AND jurisdiction_id IS NULL THEN 8 END AS own_level FROM act),
best AS (SELECT *, min(own_level) OVER (PARTITION BY context_id) AS level FROM lev),
res AS (SELECT *, CASE WHEN NOT active THEN 'inactive' WHEN own_level IS DISTINCT FROM level OR own_level IS NULL THEN 'fallback' WHEN turn = 1 THEN 'selected' WHEN texts > 1 THEN 'conflict' ELSE 'same_text' END AS status
  FROM (SELECT b.*, row_number() OVER (PARTITION BY b.context_id, b.own_level IS NOT DISTINCT FROM b.level AND b.own_level IS NOT NULL, b.clause_type, b.source_kind ORDER BY b.version DESC, b.knowledge_reference_id) AS turn, k.texts
    FROM best AS b JOIN (SELECT context_id, own_level IS NOT DISTINCT FROM level AND own_level IS NOT NULL AS m, clause_type, source_kind, count(DISTINCT reference_text) AS texts FROM best GROUP BY 1, 2, 3, 4) AS k
      ON b.context_id = k.context_id AND (b.own_level IS NOT DISTINCT FROM b.level AND b.own_level IS NOT NULL) = k.m AND b.clause_type = k.clause_type AND b.source_kind = k.source_kind) AS x)"""


def _standards(spark, sf_dir):
    return view(spark, sf_dir, "v_context"), view(spark, sf_dir, "v_knowledge_reference")


@register("s1_candidates", oracle(f"WITH {CANDIDATES} SELECT context_id, knowledge_reference_id FROM cand"))
def s1(spark, sf_dir):
    return standards.candidates(*_standards(spark, sf_dir)).select("context_id", "knowledge_reference_id")


@register("s2_active", oracle(f"SELECT knowledge_reference_id FROM v_knowledge_reference WHERE approval_status = 'approved' AND (expiry_date IS NULL OR expiry_date >= {AS_OF}) AND (effective_date IS NULL OR effective_date <= {AS_OF})"))
def s2(spark, sf_dir):
    return view(spark, sf_dir, "v_knowledge_reference").filter(standards.is_active(_as_of())).select("knowledge_reference_id")


@register("s3_s4_resolution", oracle(f"WITH {RESOLVED} SELECT context_id, knowledge_reference_id, status, level FROM res"))
def s3_s4(spark, sf_dir):
    return standards.resolve(*_standards(spark, sf_dir), _as_of()).select("context_id", "knowledge_reference_id", "status", "level")


@register("s5_resolution_summary", oracle(f"WITH {RESOLVED} SELECT context_id, max(CASE level {' '.join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(rules.STANDARD_LEVELS, start=1))} END) AS scope_level, count(*) FILTER (status = 'selected') AS n_selected, count(*) FILTER (status = 'conflict') AS n_conflicts, count(*) FILTER (status = 'fallback') AS n_fallback, count(*) FILTER (status = 'inactive') AS n_inactive FROM res GROUP BY 1"))
def s5(spark, sf_dir):
    return standards.resolution_summary(standards.resolve(*_standards(spark, sf_dir), _as_of()))


@register("s6_constraints", oracle(f"WITH {CANDIDATES} SELECT context_id, knowledge_reference_id, is_mandatory, is_prohibited FROM act WHERE active AND (is_mandatory OR is_prohibited)"))
def s6(spark, sf_dir):
    return standards.constraint_rows(*_standards(spark, sf_dir), _as_of()).select("context_id", "knowledge_reference_id", "is_mandatory", "is_prohibited")


ALL_TYPES = CANDIDATES.replace("r.clause_type = c.clause_type AND ", "")


@register("s7_constraints_all_types", oracle(f"WITH {ALL_TYPES} SELECT context_id, knowledge_reference_id, clause_type FROM act WHERE active AND (is_mandatory OR is_prohibited)"))
def s7(spark, sf_dir):
    return standards.constraint_rows(*_standards(spark, sf_dir), _as_of(), by_type=False).select("context_id", "knowledge_reference_id", "clause_type")


FOUND = """found AS (SELECT context_id AS query_id, knowledge_reference_id, version, reference_text, row_number() OVER (PARTITION BY context_id ORDER BY
   CASE WHEN r.business_unit_id = c.business_unit_id THEN 1 ELSE 0 END DESC, CASE WHEN r.jurisdiction_id = c.jurisdiction_id THEN 1 ELSE 0 END DESC, version DESC, knowledge_reference_id) AS rank
  FROM v_context AS c JOIN v_knowledge_reference AS r ON r.clause_type = c.clause_type AND (r.org_profile_id IS NULL OR r.org_profile_id = c.org_profile_id) AND approval_status = 'approved')"""


@register("s8_library_search", oracle(f"WITH {FOUND} SELECT query_id, rank, knowledge_reference_id, version FROM found WHERE rank <= 5"))
def s8(spark, sf_dir):
    contexts, library = _standards(spark, sf_dir)
    return standards.search(contexts.withColumn("query_id", F.col("context_id")), library).drop("reference_text")


APPROVED = f"""{FOUND}, chosen AS (SELECT context_id, arg_min(reference_text, knowledge_reference_id) AS resolved FROM res WHERE status = 'selected' AND source_kind = 'approved_clause' GROUP BY 1),
approved AS (SELECT c.context_id, coalesce(resolved, reference_text) AS approved_text FROM v_context AS c LEFT JOIN chosen USING (context_id) LEFT JOIN (SELECT * FROM found WHERE rank = 1) AS f ON f.query_id = c.context_id)"""


@register("s9_approved_language", oracle(f"WITH {RESOLVED}, {APPROVED} SELECT context_id, approved_text FROM approved"))
def s9(spark, sf_dir):
    return standards.approved_language(*_standards(spark, sf_dir), _as_of())


def _required(spark, sf_dir, flag):
    c = view(spark, sf_dir, "v_contract").withColumn("business_unit_id", F.col("org_profile_id") % 3)
    return standards.constrained_types(c, view(spark, sf_dir, "v_knowledge_reference"), _as_of(), flag)


_REQUIRED = """req AS (SELECT DISTINCT c.contract_id, r.clause_type FROM v_contract AS c JOIN v_knowledge_reference AS r ON (r.customer_id IS NULL OR r.customer_id = c.customer_id)
   AND (r.org_profile_id IS NULL OR r.org_profile_id = c.org_profile_id) AND (r.business_unit_id IS NULL OR r.business_unit_id = c.org_profile_id % 3)
   AND (r.jurisdiction_id IS NULL OR r.jurisdiction_id = c.jurisdiction_id) AND (r.document_type IS NULL OR r.document_type = c.document_type)
  WHERE approval_status = 'approved' AND coalesce(r.expiry_date >= DATE '2001-08-01', true) AND coalesce(r.effective_date <= DATE '2001-08-01', true) AND {})"""


@register("k7_mandatory_gaps", oracle(f"WITH {_REQUIRED.format('is_mandatory')} SELECT contract_id, clause_type FROM req WHERE NOT EXISTS (SELECT 1 FROM v_clause AS l WHERE l.contract_id = req.contract_id AND l.clause_type = req.clause_type)"))
def k7(spark, sf_dir):
    return compliance.mandatory_gaps(_required(spark, sf_dir, "is_mandatory"), view(spark, sf_dir, "v_clause"))


@register("k7_prohibited_present", oracle(f"WITH {_REQUIRED.format('is_prohibited')} SELECT req.contract_id, req.clause_type, min(clause_id) AS clause_id FROM req JOIN v_clause AS l ON l.contract_id = req.contract_id AND l.clause_type = req.clause_type GROUP BY 1, 2"))
def k7_prohibited(spark, sf_dir):
    return compliance.prohibited_present(_required(spark, sf_dir, "is_prohibited"), view(spark, sf_dir, "v_clause"))


@register("k8_ungrounded_figures", r"SELECT o_orderkey AS brief_id, CASE WHEN o_orderkey % 2 = 0 THEN '1,234,567.5' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) + 3 AS VARCHAR) END AS figure FROM orders WHERE o_orderkey % 2 = 0 OR (length(CAST(CAST(floor(o_totalprice) AS BIGINT) + 3 AS VARCHAR)) >= 4 AND abs(CAST(floor(o_totalprice) AS BIGINT) + 3 - o_totalprice) > 1.0)")
def k8(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    near = (F.floor("o_totalprice") + 3).cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, "worth 1,234,567.5 on page 12").otherwise(F.concat(F.lit("worth "), near, F.lit(" or about, see 99")))
    value = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.col("o_totalprice"))
    return compliance.ungrounded_figures(o.select(F.col("o_orderkey").alias("brief_id"), text.alias("text"), value.alias("monetary_value")))


@register("k9_checklists", oracle("SELECT contract_id, CASE WHEN org_profile_id % 3 = 0 THEN CASE WHEN document_type = 'supply' THEN 'audit_rights' ELSE 'termination,payment' END ELSE 'termination,liability_cap,confidentiality,governing_law' END AS expected FROM v_contract"))
def k9(spark, sf_dir):
    own = F.when(F.col("org_profile_id") % 3 == 0, F.create_map(F.lit("supply"), F.array(F.lit("audit_rights")), F.lit("default"), F.array(F.lit("termination"), F.lit("payment"))))
    c = view(spark, sf_dir, "v_contract").withColumn("own", own)
    return c.select("contract_id", F.array_join(compliance.checklist(F.col("document_type"), F.col("own")), ",").alias("expected"))


_LABEL = r"CASE WHEN regexp_matches(text, '\bstrictly\s+confidential\b', 'i') THEN 'highly_confidential' WHEN regexp_matches(text, '\bconfidential\b', 'i') THEN 'confidential' WHEN regexp_matches(text, '\binternal\s+use\s+only\b', 'i') THEN 'internal' WHEN regexp_matches(text, '\bpublic\s+filing\b', 'i') THEN 'public' END"
_GROUPS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"position('{w}' IN lower(text)) > 0" for w in words) + f" THEN '{name}' END" for name, (_, words) in rules.SIGNALS.items()) + "], lambda x: x IS NOT NULL)"
_HIGH = "'" + "', '".join(n for n, (level, _) in rules.SIGNALS.items() if level == "highly_confidential") + "'"
CLASSIFIED = f"""lab AS (SELECT *, {_LABEL} AS explicit_level, {_GROUPS} AS signals FROM v_classified),
cls AS (SELECT *, coalesce(explicit_level, CASE WHEN len(list_filter(signals, lambda x: x IN ({_HIGH}))) > 0 THEN 'highly_confidential' WHEN len(signals) > 0 THEN 'confidential' END,
   CASE WHEN lower(document_type) IN ('nda', 'non-disclosure') THEN 'confidential' END) AS suggested_level FROM lab)"""


@register("c1_c2_classify", oracle(f"WITH {CLASSIFIED} SELECT document_id, explicit_level, array_to_string(signals, ',') AS signals, suggested_level FROM cls"))
def c1_c2(spark, sf_dir):
    out = sensitivity.classify(view(spark, sf_dir, "v_classified"))
    return out.select("document_id", "explicit_level", F.array_join("signals", ",").alias("signals"), "suggested_level")


_R = lambda x: f"CASE {x} WHEN 'public' THEN 0 WHEN 'confidential' THEN 2 WHEN 'highly_confidential' THEN 3 ELSE 1 END"
COMBINED = f"""num AS (SELECT *, {_R("coalesce(model_level, 'internal')")} AS m, CASE WHEN explicit_level IS NOT NULL THEN {_R('explicit_level')} END AS e, CASE WHEN suggested_level IS NOT NULL THEN {_R('suggested_level')} END AS s FROM cls),
mix AS (SELECT *, CASE WHEN e IS NOT NULL THEN greatest(e, m) WHEN s IS NOT NULL THEN greatest(s, m) ELSE m END AS r, e IS NULL AND s IS NOT NULL AND abs(s - m) > 1 AS gap FROM num),
conf AS (SELECT *, CASE WHEN ocr_ratio > 0.5 THEN least(c0, 0.4) ELSE c0 END AS c FROM (SELECT *, CASE WHEN e IS NOT NULL THEN greatest(model_confidence, 0.9) WHEN gap THEN least(model_confidence, 0.5) ELSE model_confidence END::DOUBLE AS c0 FROM mix) AS y)"""


@register("c3_combine", oracle(f"WITH {CLASSIFIED}, {COMBINED} SELECT document_id, CASE WHEN r = 0 AND (c < 0.6 OR s IS NULL) THEN 'internal' ELSE ['public', 'internal', 'confidential', 'highly_confidential'][r + 1] END AS level, round(c, 3) AS confidence, coalesce(gap, false) OR ocr_ratio > 0.8 OR (r = 0 AND (c < 0.6 OR s IS NULL)) AS needs_confirmation FROM conf"))
def c3(spark, sf_dir):
    rows = view(spark, sf_dir, "v_classified").withColumns({"model_confidence": F.col("model_confidence").cast("double"), "ocr_ratio": F.col("ocr_ratio").cast("double")})
    return sensitivity.combine(sensitivity.classify(rows)).select("document_id", "level", "confidence", "needs_confirmation")


@register("c4_access", oracle("SELECT document_id, model_level FROM v_classified WHERE coalesce(model_level, 'internal') IN ('public', 'internal', 'confidential')"))
def c4(spark, sf_dir):
    docs = view(spark, sf_dir, "v_classified").withColumn("confidentiality_level", F.col("model_level"))
    return sensitivity.readable(docs, sensitivity.access_table(spark), "reviewer").select("document_id", "model_level")


@register("p1_deviation", oracle(f"SELECT clause_id, round(s, 4) AS similarity, round(1 - s, 4) AS deviation, round(1 - 4 * s * (1 - s), 3) AS confidence FROM (SELECT a.clause_id, {sql_cosine('a.embedding', 'b.embedding')} AS s FROM v_vector AS a LEFT JOIN v_vector AS b ON b.clause_id = a.label AND a.clause_id % 3 > 0) AS x"))
def p1(spark, sf_dir):
    v = view(spark, sf_dir, "v_vector")
    approved = v.select(F.col("clause_id").alias("label"), F.col("embedding").alias("approved"))
    rows = v.join(approved, "label", "left").select("clause_id", F.col("embedding").alias("clause_vector"), F.when(F.col("clause_id") % 3 > 0, F.col("approved")).alias("approved_vector"))
    return scoring.deviation(rows).select("clause_id", "similarity", "deviation", "confidence")


_COMPONENTS = "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 11) / 10.0::DOUBLE END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 7) / 10.0::DOUBLE END AS b, CASE WHEN event_id % 2 = 0 THEN NULL ELSE (event_id % 9) / 10.0::DOUBLE END AS c FROM events) AS x"
_COMPOSITE = "round((CASE WHEN a IS NULL THEN 0 ELSE 0.3::DOUBLE * a END + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE * b END + CASE WHEN c IS NULL THEN 0 ELSE 0.4::DOUBLE * c END) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.4::DOUBLE END, 0), 3)"


@register(
    "p2_p3_confidence",
    f"""SELECT event_id, composite, CASE WHEN composite < 0.7 THEN concat('low confidence: ', CASE WHEN a = w THEN 'source OCR quality' WHEN b = w THEN 'retrieval relevance' ELSE 'model self-reported confidence' END, ' ', CAST(round(w * 100, 0) AS INT), '%') END AS reason
      FROM (SELECT *, {_COMPOSITE} AS composite, least(a, b, c) AS w FROM {_COMPONENTS}) AS y""",
)
def p2_p3(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = lambda skip, m: F.when(F.col("event_id") % skip != 0, (F.col("event_id") % m) / 10.0)
    rows = e.select("event_id", part(3, 11).alias("ocr_quality"), part(5, 7).alias("retrieval_relevance"), part(2, 9).alias("llm_confidence"))
    return scoring.low_confidence_reason(rows).select("event_id", "composite", "reason")


_BAR = "CASE WHEN contract_id % 3 = 0 THEN 'medium' END"


@register("p4_assigned_role", oracle(f"SELECT risk_flag_id, CASE WHEN severity = coalesce({_BAR}, 'high') OR (severity IN ('medium', 'high') AND confidence < CASE WHEN contract_id % 2 = 0 THEN 0.7 ELSE 0.6 END) THEN 'senior_counsel' ELSE 'reviewer' END AS assigned_role FROM v_risk_flag"))
def p4(spark, sf_dir):
    bar, floor = F.when(F.col("contract_id") % 3 == 0, "medium"), F.when(F.col("contract_id") % 2 == 0, 0.7)
    return view(spark, sf_dir, "v_risk_flag").select("risk_flag_id", scoring.assigned_role(F.col("severity"), F.col("confidence"), bar, floor).alias("assigned_role"))


@register(
    "p5_risk_table",
    oracle(
        f"""WITH {EXPECTED}, f AS (
          SELECT contract_id, clause_id, category, severity, confidence FROM v_risk_flag
          UNION ALL SELECT contract_id, clause_id, 'auto_renewal', 'medium', 1.0 FROM v_clause WHERE text LIKE '%automatically renew%'
          UNION ALL SELECT contract_id, clause_id, 'excessive_liability', 'high', 1.0 FROM v_clause WHERE clause_type = 'liability_cap' AND text LIKE '%Unlimited Liability%'
          UNION ALL SELECT contract_id, NULL, 'duplicate_clause', 'medium', 1.0 FROM (SELECT contract_id, clause_type FROM v_clause WHERE clause_type NOT IN ('payment', 'warranty') GROUP BY 1, 2 HAVING count(*) > 1) AS d
          UNION ALL SELECT contract_id, NULL, 'value_threshold', 'high', 1.0 FROM v_contract WHERE monetary_value >= 400000
          UNION ALL SELECT contract_id, NULL, 'missing_clause', 'medium', 1.0 FROM v_contract JOIN expected AS e USING (document_type) WHERE NOT EXISTS (SELECT 1 FROM v_clause AS l WHERE l.contract_id = v_contract.contract_id AND l.clause_type = e.clause_type))
        SELECT contract_id, clause_id, category, severity, CASE WHEN severity = 'high' OR (severity = 'medium' AND confidence < 0.6) THEN 'senior_counsel' ELSE 'reviewer' END AS assigned_role FROM f"""
    ),
)
def p5(spark, sf_dir):
    contracts, clauses = view(spark, sf_dir, "v_contract"), view(spark, sf_dir, "v_clause")
    model = view(spark, sf_dir, "v_risk_flag").select("contract_id", "clause_id", "category", "severity", "confidence", F.lit("review").alias("action"), F.lit("model").alias("rule_source"))
    found = [
        model,
        scoring.finding(compliance.auto_renewal(clauses), "auto_renewal", "medium"),
        scoring.finding(compliance.unlimited_liability(clauses), "excessive_liability", "high"),
        scoring.finding(compliance.duplicate_types(clauses), "duplicate_clause", "medium", clause=False),
        scoring.finding(compliance.over_value(contracts, 400000.0), "value_threshold", "high", clause=False),
        scoring.finding(compliance.missing_clauses(contracts, clauses), "missing_clause", "medium", clause=False),
    ]
    return scoring.risk_table(found).select("contract_id", "clause_id", "category", "severity", "assigned_role")


