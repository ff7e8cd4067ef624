"""Review workflow: approval chains and their progress, playbooks, gates, briefs, job outcomes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.functions import columns as C
from contractlake.functions import rules

STEPS = "array<struct<required_role:string,reason:string>>"


def approval_chain(documents: DataFrame) -> DataFrame:
    """document_id, sequence, required_role, reason.

    documents: document_id, monetary_value, confidentiality_level, has_high_risk, value_threshold,
    require_clo, approval_policy (array of struct<required_role, reason>, taken as it is if not empty).
    """
    bar = F.coalesce("value_threshold", F.lit(rules.VALUE_THRESHOLD))
    high, over = F.coalesce("has_high_risk", F.lit(False)), F.coalesce(F.col("monetary_value") >= bar, F.lit(False))
    secret = F.coalesce(F.col("confidentiality_level") == "highly_confidential", F.lit(False))
    step = lambda role, reason: F.struct(F.lit(role).alias("required_role"), reason.alias("reason"))
    why = F.concat_ws("; ", F.when(high, rules.REASONS["high_risk"]), F.when(over, F.concat(F.lit(rules.REASONS["over_value"]), F.format_number(bar, 0))))
    clo = F.when(secret, rules.REASONS["secret"]).otherwise(rules.REASONS["clo"])
    default = F.array_compact(F.array(
        step("reviewer", F.lit(rules.REASONS["reviewer"])), step("senior_counsel", F.lit(rules.REASONS["senior_counsel"])),
        F.when(high | over, step("business_head", why)), F.when(secret | F.coalesce("require_clo", F.lit(False)), step("clo", clo)),
    ))
    policy = F.transform("approval_policy", lambda s: step_of(s))
    chain = F.when(F.size(F.coalesce("approval_policy", F.array().cast(STEPS))) > 0, policy).otherwise(default)
    return documents.select("document_id", F.posexplode(chain).alias("pos", "s")).select(
        "document_id", (F.col("pos") + 1).alias("sequence"), "s.required_role", "s.reason"
    )


def step_of(s: Column) -> Column:
    return F.struct(s["required_role"].alias("required_role"), F.coalesce(s["reason"], F.lit(rules.REASONS["policy"])).alias("reason"))


PAST = {"approve": "approved", "approve_with_changes": "approved_with_changes", "reject": "rejected", "send_back": "sent_back"}


def past(decision: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in PAST.items():
        out = F.when(decision == a, b).otherwise(out)
    return out


def chain_progress(steps: DataFrame) -> DataFrame:
    """Adds `status` to steps (brief_id, sequence, decision or null): nothing follows a rejection or a send-back."""
    ended = F.min(F.when(F.col("decision").isin("reject", "send_back"), F.col("sequence"))).over(W.partitionBy("brief_id"))
    return steps.withColumn("status", F.when(F.col("sequence") > ended, "skipped").otherwise(F.coalesce(past(F.col("decision")), F.lit("pending"))))


def brief_status(progress: DataFrame) -> DataFrame:
    """brief_id, status: what ended the chain, the last step's decision once all are decided, else in_review."""
    ended = F.max(F.when(F.col("status").isin("rejected", "sent_back"), F.col("status")))
    open_ = F.count_if(F.col("status") == "pending")
    last = F.max_by("status", "sequence")
    return progress.groupBy("brief_id").agg(F.when(ended.isNotNull(), ended).when(open_ == 0, last).otherwise("in_review").alias("status"))


def next_steps(progress: DataFrame) -> DataFrame:
    """The first pending step of each brief."""
    waiting = progress.filter("status = 'pending'")
    return waiting.groupBy("brief_id").agg(F.min("sequence").alias("sequence"), F.min_by("required_role", "sequence").alias("required_role"))


def playbook_rows(entries: DataFrame, flags: DataFrame, clauses: DataFrame) -> DataFrame:
    """Entries with their document: through the flag's clause, or through the flag itself."""
    flagged = entries.join(flags, "risk_flag_id")
    by_clause = flagged.filter("clause_id is not null").drop("document_id").join(clauses.select("clause_id", "document_id"), "clause_id")
    by_document = flagged.filter("clause_id is null")
    columns = ["document_id", "risk_flag_id", "severity", "confidence", "fallback_source"]
    return by_clause.select(*columns).unionByName(by_document.select(*columns))


def playbook_order(rows: DataFrame) -> DataFrame:
    """Adds `priority` (from 1) within each document: severity, then confidence (null last, as 1.0), then id."""
    rank = C.rank_of(F.col("severity"), {"high": 0, "medium": 1, "low": 2}, 3)
    w = W.partitionBy("document_id").orderBy(rank, F.coalesce("confidence", F.lit(1.0)), "risk_flag_id")
    return rows.withColumn("priority", F.row_number().over(w))


def playbook_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_entries"), F.count_if(F.col("severity") == "high").alias("high_severity"),
        F.count_if(F.col("fallback_source") == "org_profile").alias("org_profile_sourced"),
        F.count_if(F.col("fallback_source") == "llm_generated").alias("llm_sourced"),
    )


def fallbacks(flags: DataFrame, approved: DataFrame, generated: DataFrame) -> DataFrame:
    """Fallback positions of medium and high flags: approved language and current text, else what the model supplied.

    flags: risk_flag_id, context_id, severity, text. approved: context_id, approved_text. generated: risk_flag_id, positions, redline.
    """
    rows = flags.filter(F.col("severity").isin("medium", "high")).join(approved, "context_id", "left").join(generated, "risk_flag_id", "left")
    known = F.col("approved_text").isNotNull()
    return rows.select(
        "risk_flag_id", F.when(known, F.array("approved_text", "text")).otherwise(F.coalesce("positions", F.array().cast("array<string>"))).alias("fallback_positions"),
        F.when(known, "org_profile").otherwise("llm_generated").alias("fallback_source"),
        F.when(known, F.col("approved_text")).otherwise(F.col("redline")).alias("suggested_redline"),
    )


def may_act(actor: Column, assigned: Column, seniority: dict[str, int] = rules.SENIORITY) -> Column:
    """Whether the actor's role is senior enough; unknown actors never are for known roles, unknown assignments need none."""
    return C.rank_of(actor, seniority, -1) >= C.rank_of(assigned, seniority, 0)


def decision_problem(decision: Column, comments: Column, changes: Column, reason: Column) -> Column:
    """What a decision lacks; null if nothing."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(~decision.isin(*PAST) | decision.isNull(), "unknown decision")
        .when((decision == "reject") & blank(comments), "comments required")
        .when((decision == "approve_with_changes") & blank(changes), "required changes missing")
        .when((decision == "send_back") & blank(reason), "reason required")
    )


def unreviewed(briefs: DataFrame, actions: DataFrame) -> DataFrame:
    """Briefs of documents without any review action."""
    return briefs.join(actions.select("document_id"), "document_id", "left_anti")


def brief_inputs(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Each document with its children as arrays of structs; children are grouped before the join, so rows never multiply."""
    out = documents
    for name, rows in children.items():
        fields = [c for c in rows.columns if c != "document_id"]
        grouped = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(grouped, "document_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def brief_versions(briefs: DataFrame) -> DataFrame:
    """Numbers the briefs (document_id, brief_id, status, recommendation, created_at) and marks those that a later one supersedes."""
    w = W.partitionBy("document_id").orderBy("created_at", "brief_id")
    out = briefs.withColumn("version_number", F.row_number().over(w)).withColumn("__next", F.lead(F.lit(1)).over(w))
    superseded = F.when((F.col("status") == "sent_back") & F.col("__next").isNotNull(), F.col("version_number") + 1)
    known = F.when(F.col("recommendation").isin("approve", "approve_with_changes", "reject", "escalate"), F.col("recommendation")).otherwise("escalate")
    return out.withColumn("superseded_by_version", superseded).withColumn("recommendation", known).drop("__next")


def deciding_events(events: DataFrame, *, revisions: int = 3) -> DataFrame:
    """The events that decide the fold of a job: its first `revisions` + 1 of each kind (ending, revise, other), in (time, id) order.

    The first that ends and the first `revisions` + 1 that revise give the same outcome as all; the
    others keep jobs that have neither. Spark cuts before the shuffle while the limit is under its
    windowGroupLimitThreshold (1,000).
    """
    kind = F.when(F.col("decision").isin("proceed", "reject", "escalate"), "end").when(F.col("decision") == "revise", "revise").otherwise("other")
    rank = F.row_number().over(W.partitionBy("job_id", "__kind").orderBy("event_time", "event_id", "decision"))
    rows = events.select("job_id", "event_time", "event_id", "decision").withColumn("__kind", kind).withColumn("__rank", rank)
    return rows.filter(F.col("__rank") <= revisions + 1).drop("__kind", "__rank")


def job_outcomes(events: DataFrame, *, revisions: int = 3) -> DataFrame:
    """job_id, outcome, revisions: a fold over each job's checkpoint decisions in (time, id) order.

    proceed ends well, reject and escalate end; revise counts, and one more than `revisions` escalates.
    events: job_id, event_time, event_id, decision. Only a job's deciding events come together.
    """
    ordered = F.array_sort(F.collect_list(F.struct("event_time", "event_id", "decision")))
    state = F.struct(F.lit("open").alias("outcome"), F.lit(0).alias("revisions"))

    def step(s: Column, e: Column) -> Column:
        again = e["decision"] == "revise"
        count = s["revisions"] + F.when(again, 1).otherwise(0)
        after = (
            F.when(e["decision"] == "proceed", "finalized").when(e["decision"] == "reject", "rejected").when(e["decision"] == "escalate", "escalated")
            .when(again & (count > revisions), "escalated").otherwise("open")
        )
        return F.when(s["outcome"] != "open", s).otherwise(F.struct(after.alias("outcome"), F.least(count, F.lit(revisions)).alias("revisions")))

    folded = deciding_events(events, revisions=revisions).groupBy("job_id").agg(F.aggregate(ordered, state, step).alias("s"))
    return folded.select("job_id", "s.outcome", "s.revisions")


def job_outcomes_pandas(events: DataFrame, *, revisions: int = 3) -> DataFrame:
    """The same fold as grouped Python, for rules that columns can't say."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        outcome, count = "open", 0
        for decision in rows.sort_values(["event_time", "event_id"])["decision"]:
            count += decision == "revise"
            outcome = {"proceed": "finalized", "reject": "rejected", "escalate": "escalated"}.get(decision, "escalated" if count > revisions else "open")
            if outcome != "open":
                break
        return pd.DataFrame({"job_id": [rows["job_id"].iloc[0]], "outcome": [outcome], "revisions": [min(count, revisions)]})

    return deciding_events(events, revisions=revisions).groupBy("job_id").applyInPandas(fold, "job_id long, outcome string, revisions int")


def approval_state(decisions: DataFrame) -> DataFrame:
    """contract_id, approved (true, false, or null while escalated), status, from the latest decision (contract_id, decision, seq)."""
    last = decisions.groupBy("contract_id").agg(F.max_by("decision", "seq").alias("decision"))
    approved = F.when(F.col("decision") == "approve", True).when(F.col("decision") == "reject", False)
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").otherwise("awaiting_review")
    return last.select("contract_id", approved.alias("approved"), status.alias("status"))


def approval_summary(documents: DataFrame, clauses: DataFrame, conflicts: DataFrame, flags: DataFrame, missing: DataFrame) -> DataFrame:
    """Counts of each document's clauses, conflicts, high flags and missing clauses; every child is counted before it is joined."""
    count = lambda df, name: df.groupBy("contract_id").agg(F.count(F.lit(1)).alias(name))
    out = documents.select("contract_id")
    for df, name in ((clauses, "n_clauses"), (conflicts, "n_conflicts"), (flags.filter("severity = 'high'"), "n_high_risk"), (missing, "n_missing")):
        out = out.join(count(df, name), "contract_id", "left")
    return out.na.fill(0, ["n_clauses", "n_conflicts", "n_high_risk", "n_missing"])


def high_risk_details(flags: DataFrame, clauses: DataFrame, size: int = 400) -> DataFrame:
    """Each document's high flags with previews of their clauses, as an array."""
    rows = flags.filter("severity = 'high'").join(clauses.select("clause_id", "clause_type", "text"), "clause_id", "left")
    item = F.struct("clause_id", "clause_type", "category", C.preview(F.col("text"), size).alias("preview"))
    return rows.groupBy("contract_id").agg(F.array_sort(F.collect_list(item)).alias("high_risk"))

