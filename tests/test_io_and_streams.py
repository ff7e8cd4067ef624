import json

from pyspark.sql import functions as F

from contractlake.functions import hooks
from contractlake.operators import history, workflow
from contractlake.sources import io, schemas
from contractlake.streaming import streams


def test_json_csv_and_logs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"policy_id": "p", "applies_to": ["x", "y"]}, {"policy_id": "q"}]))
    assert [r["applies_to"] for r in io.read_json_array(spark, str(tmp_path / "a.json"), schemas.POLICIES).orderBy("policy_id").collect()] == [["x", "y"], None]
    (tmp_path / "a.csv").write_text('risk_category,severity,description\nr,high,"a, ""b"""\n')
    assert io.read_csv(spark, str(tmp_path / "a.csv"), schemas.RISK_TAXONOMY).first()["description"] == 'a, "b"'
    log = str(tmp_path / "log")
    for q in ("one", "two"):
        io.append_log(spark.createDataFrame([(q, "a")], "question string, answer string"), log)
    (tmp_path / "log" / "extra.json").write_text('\n{"question": "three"}\n\n')
    assert {r["question"] for r in io.read_log(spark, log, schemas.CHAT_LOG).collect()} == {"one", "two", "three"}


def test_tables_round_trip(spark, tmp_path):
    io.write_table(spark.createDataFrame([("c", "X")], "customer_id string, code string"), str(tmp_path), "customer")
    row = io.read_table(spark, str(tmp_path), "customer").first()
    assert (row["customer_id"], row["code"], row["is_active"]) == ("c", "X", None)
    assert len(schemas.TABLES) == 18


def test_events_are_partitioned_by_date(spark, tmp_path):
    row = spark.createDataFrame([("j", "done", "", "2024-05-01 10:00:00")], "job_id string, status string, detail string, timestamp string")
    io.record_events(row, str(tmp_path), "terminal_state")
    assert (tmp_path / "terminal_state" / "date=2024-05-01").is_dir()


def test_upload_guard(spark):
    rows = [("a.pdf", "application/pdf", 10, 3, "", ""), ("a.exe", None, 10, 3, "", ""), ("a.PDF", "text/html", 10, 3, "", ""), ("a.docx", None, 0, 3, "", ""), ("a.docx", None, 60 << 20, 3, "", ""), ("b.pdf", None, 5, 301, "", ""), ("b.pdf", None, 5, 1, "q" * 2001, ""), ("pdf", None, 5, 1, "", "")]
    df = spark.createDataFrame(rows, "name string, content_type string, n_bytes long, n_pages int, question string, comment string").coalesce(1)
    got = [r["x"] for r in df.select(io.reject_reason().alias("x")).collect()]
    assert got == [None, "unsupported extension", "content type mismatch", "empty file", "file too large", "too many pages", "question too long", "unsupported extension"]


def test_seeding_twice_adds_nothing(spark):
    target = spark.createDataFrame([], "title string, org_profile_id int")
    seeds, profiles = spark.createDataFrame([("a",), ("b",)], "title string"), spark.createDataFrame([(1,), (2,)], "org_profile_id int")
    once = io.seed_if_absent(target, seeds, profiles, ["title", "org_profile_id"])
    assert once.count() == io.seed_if_absent(once, seeds, profiles, ["title", "org_profile_id"]).count() == 4


def test_versions(spark):
    schema = "document_id int, version_number int, summary_text string, edited_by string, approval_status string, created_at int"
    stored = spark.createDataFrame([(1, 1, "a", None, "draft", 1), (1, 2, "b", "me", "draft", 2)], schema)
    marked, unknown = history.approve_versions(stored, spark.createDataFrame([(1, 1), (1, 9)], "document_id int, version_number int"))
    assert {r["version_number"]: r["approval_status"] for r in marked.collect()} == {1: "approved", 2: "draft"}
    assert [r["version_number"] for r in unknown.collect()] == [9]
    back = history.restore_versions(stored, spark.createDataFrame([(1, 1, "me", 3)], "document_id int, version_number int, edited_by string, created_at int")).first()
    assert (back["version_number"], back["summary_text"], back["restored_from_version"], back["is_ai_generated"]) == (3, "a", 1, False)


def test_manual_level_blocks_automatic(spark):
    rows = [(1, 1, "automatic", "internal"), (1, 2, "manual", "public"), (1, 3, "automatic", "confidential"), (1, 4, "manual", "internal")]
    h = history.confidentiality_history(spark.createDataFrame(rows, "document_id int, seq int, source string, new_level string"))
    assert [(r["seq"], r["previous_level"]) for r in h.orderBy("seq").collect()] == [(1, None), (2, "internal"), (4, "public")]


def test_hooks(spark):
    df = spark.createDataFrame([(1, "pay the fee"), (2, "pay the fee"), (3, "")], "i int, text string")
    v = {r["i"]: r["embedding"] for r in hooks.with_embeddings(df).collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-6 and sum(v[3]) == 0
    own = hooks.with_embeddings(df, lambda: lambda texts: [[float(len(t))] for t in texts])
    assert {r["i"]: r["embedding"] for r in own.collect()}[1] == [11.0]


def _stream(spark, rows, path):
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _run(frame, mode, name, tmp_path):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("audit_id"), F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("action")
    )
    live = _stream(spark, events, str(tmp_path / "events"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(_run(streams.action_counts(live), "complete", "tumbling", tmp_path)) == rows(streams.action_counts(events))
    requests = events.select(F.col("job_id").cast("string").alias("key"), F.col("audit_id").alias("request_id"), (F.unix_micros("event_time") / 1e6).alias("at"))
    live = _stream(spark, requests, str(tmp_path / "requests"))
    want = rows(streams.admissions(requests, most=2, seconds=86400.0))
    assert rows(_run(streams.admissions_stream(live, most=2, seconds=86400.0), "append", "admitted", tmp_path)) == want
    assert any(r[3] for r in want) and not all(r[3] for r in want)
    decision = F.when(F.col("audit_id") % 23 == 0, "proceed").when(F.col("audit_id") % 29 == 0, "reject").otherwise("revise")
    jobs = events.select("job_id", "event_time", F.col("audit_id").alias("event_id"), decision.alias("decision"))
    live = _stream(spark, jobs, str(tmp_path / "jobs"))
    assert rows(_run(streams.job_states(live), "update", "jobs_seen", tmp_path)) == rows(workflow.job_outcomes(jobs))


def test_ingest_stream_drops_repeats_and_upserts(spark, tmp_path):
    up = spark.createDataFrame([("d", "Same  text"), ("d", " same text "), ("d", "other")], "document_id string, text string").withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    live = _stream(spark, up, str(tmp_path / "uploads"))
    assert _run(streams.new_documents(live), "append", "fresh", tmp_path).count() == streams.new_documents(up).count() == 2
    arrivals = spark.createDataFrame([(1, "h", "c1", 1, 0.5, 1), (1, "h", "c2", 2, 0.9, 2)], "document_id int, content_hash string, clause_id string, page_reference int, confidence double, seq int")
    live = _stream(spark, arrivals, str(tmp_path / "arrivals"))
    streams.upsert_batches(live, str(tmp_path / "merged"), str(tmp_path / "mark")).awaitTermination(120)
    row = spark.read.parquet(str(tmp_path / "merged" / "batch=0")).first()
    assert (row["clause_id"], row["version"]) == ("c1", 2)


def test_sliding_admission(spark):
    r = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate([0, 1, 2, 11, 11.5])], "key string, request_id long, at double")
    got = {x["request_id"]: x["accepted"] for x in streams.admissions(r, most=2, seconds=10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}
