"""Queries that write the given tables through a sink and read them back (I, V, X), in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.plans.bindings import oracle, view
from contractlake.plans.registry import register
from contractlake.plans.review_queries import _OUTCOMES, ADMISSIONS, _decisions, _requests
from contractlake.plans.text_queries import UPSERTED, arrival_batches, clause_arrivals
from contractlake.session import shared_path
from contractlake.sources import io, schemas
from contractlake.streaming import clause_log, expiring, streams


@register("i2_json_array", "SELECT n_nationkey AS policy_id, n_name AS title, [CAST(n_regionkey AS VARCHAR), n_name][2] AS last_scope FROM nation")
def i2(spark, sf_dir):
    path = shared_path(spark, "policies")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")  # a reference list of a few rows: one array, one file
    row = F.struct(F.col("n_nationkey").alias("policy_id"), F.col("n_name").alias("title"), F.array(F.col("n_regionkey").cast("string"), "n_name").alias("applies_to"))
    nation.agg(F.to_json(F.collect_list(row)).alias("value")).write.text(path)
    return io.read_json_array(spark, path, "policy_id long, title string, applies_to array<string>").select("policy_id", "title", F.element_at("applies_to", -1).alias("last_scope"))


@register("i3_csv", """SELECT c_custkey, concat(c_name, ', "', c_mktsegment, '"') AS label, c_acctbal FROM customer""")
def i3(spark, sf_dir):
    path = shared_path(spark, "risks")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = c.select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("label"), "c_acctbal")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return io.read_csv(spark, path, "c_custkey long, label string, c_acctbal double")


@register("i4_chat_log", oracle("SELECT CAST(document_id AS VARCHAR) AS document_id, question, answer FROM v_chat"))
def i4(spark, sf_dir):
    path = shared_path(spark, "chat-log")
    rows = view(spark, sf_dir, "v_chat").select("question", "answer", F.array("question").alias("contexts"), F.col("document_id").cast("string").alias("document_id"), "turn")
    io.append_log(rows.filter("turn % 2 = 0").drop("turn"), path)
    io.append_log(rows.filter("turn % 2 <> 0").drop("turn"), path)
    return io.read_log(spark, path, schemas.CHAT_LOG).select("document_id", "question", "answer")


@register("i5_exported_chunks", oracle("SELECT clause_id AS chunk_id, contract_id AS document, page_start, clause_type FROM v_clause"))
def i5(spark, sf_dir):
    path = shared_path(spark, "chunks")
    rows = view(spark, sf_dir, "v_clause").select(F.col("clause_id").alias("chunk_id"), F.col("contract_id").alias("document"), "page_start", "clause_type")
    io.export_chunks(rows, path)
    return spark.read.schema("chunk_id string, document long, page_start int, clause_type string").json(path).select("chunk_id", "document", "page_start", "clause_type")


@register("i8_operational_table", oracle("SELECT clause_id, CAST(contract_id AS VARCHAR) AS document_id, clause_type, text AS extracted_text, CAST(NULL AS INT) AS version FROM v_clause"))
def i8(spark, sf_dir):
    root = shared_path(spark, "tables")
    rows = view(spark, sf_dir, "v_clause").select("clause_id", F.col("contract_id").alias("document_id"), "clause_type", F.col("text").alias("extracted_text"), F.lit("x").alias("undeclared"))
    io.write_table(rows, root, "clause")
    return io.read_table(spark, root, "clause").select("clause_id", "document_id", "clause_type", "extracted_text", "version")


@register("v9_recorded_events", oracle("SELECT CAST(audit_id AS VARCHAR) AS audit_id, action, CAST(job_id AS VARCHAR) AS actor, strftime(event_time, '%Y-%m-%d') AS day FROM v_audit_event"))
def v9(spark, sf_dir):
    root = shared_path(spark, "events")
    none = F.lit(None).cast("string")
    e = view(spark, sf_dir, "v_audit_event").select(
        "audit_id", none.alias("document_id"), F.lit("review").alias("stage"), F.col("job_id").alias("actor"), "action", "details", F.col("event_time").alias("timestamp")
    )
    io.record_events(e, root, "audit_log")
    back = spark.read.schema(f"{schemas.EVENTS['audit_log']}, date date").parquet(f"{root}/audit_log")
    return back.select("audit_id", "action", "actor", F.date_format("date", "yyyy-MM-dd").alias("day"))


@register("x4_job_states", _OUTCOMES)
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of decisions, run over what is there; of each job's states the one of the newest batch stands."""
    source, out, checkpoint = (shared_path(spark, f"decisions-{x}") for x in ("in", "out", "checkpoint"))
    rows = _decisions(spark, sf_dir)
    rows.write.parquet(source)
    states = expiring.job_states(expiring.stateful_session(spark).readStream.schema(rows.schema).parquet(source))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    states.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(f"{streams.JOB}, batch long").parquet(out)
    last = found.groupBy("job_id").agg(F.max_by(F.struct("outcome", "revisions"), "batch").alias("s"))
    return last.select("job_id", "s.outcome", "s.revisions")


@register("x2_merged_clauses", UPSERTED)
def x2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals in three runs of one stream into the log of deltas, folded after the second; the last batch is delivered again."""
    source, log, checkpoint = (shared_path(spark, f"arrivals-{x}") for x in ("in", "log", "checkpoint"))
    rows = clause_arrivals(spark, sf_dir)
    parts = arrival_batches(rows, 3_000_000_000, 5_000_000_000)
    for n, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        streams.log_batches(spark.readStream.schema(rows.schema).parquet(source), log, checkpoint).awaitTermination()
        if n == 1:
            clause_log.compact(spark, log)
    clause_log.apply_batch(parts[2], log, len(parts) - 1)
    return clause_log.read(spark, log)


@register("x3_admissions_stream", ADMISSIONS)
def x3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of requests, run over what is there, with state that ends."""
    source, out, checkpoint = (shared_path(spark, f"requests-{x}") for x in ("in", "out", "checkpoint"))
    rows = _requests(spark, sf_dir)
    rows.write.parquet(source)
    session = expiring.stateful_session(spark)
    found = expiring.admissions_stream(session.readStream.schema(rows.schema).parquet(source), most=2, seconds=86400.0)
    found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(streams.ADMITTED).parquet(out)
