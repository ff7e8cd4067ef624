"""The log of deltas, streams whose state ends, paths of any length."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from contractlake.operators import dedup, graph, workflow
from contractlake.streaming import clause_log, expiring, streams

ARRIVALS = "document_id string, content_hash string, clause_id string, page_reference int, confidence double, seq long"


def _rows(df):
    return sorted(map(repr, df.select("document_id", "content_hash", "clause_id", "page_reference", "confidence", "version").collect()))


def _files(root):
    return {p for p in root.rglob("*.parquet")}


def _batches(seed, many, each):
    rng, seq = random.Random(seed), 0
    for _ in range(many):
        out = []
        for _ in range(each):
            seq += 1
            out.append((f"d{rng.randrange(4)}", f"h{rng.randrange(3)}", rng.choice([f"c{seq}", None]), rng.choice([seq, None]), rng.choice([seq / 8, None]), seq))
        yield out


def test_log_equals_merged_tables_with_replays_and_compaction(spark, tmp_path, capsys):
    root, stored = str(tmp_path / "log"), None
    assert clause_log.read(spark, root) is None and not clause_log.compact(spark, root)
    for n, rows in enumerate(_batches(7, 4, 9)):
        batch = spark.createDataFrame(rows, ARRIVALS)
        assert clause_log.apply_batch(batch, root, n, buckets=4)
        stored = dedup.upsert_clauses(batch) if stored is None else dedup.merge_clauses(stored, batch)
        assert _rows(clause_log.read(spark, root, buckets=4)) == _rows(stored)
        before, version = _files(tmp_path), clause_log.state(spark, root).version
        assert not clause_log.apply_batch(batch, root, n, buckets=4)
        assert _files(tmp_path) == before and clause_log.state(spark, root).version == version
        if n == 2:
            assert clause_log.compact(spark, root, buckets=4) and clause_log.state(spark, root).folders == [(2, "base")]
            assert _rows(clause_log.read(spark, root, buckets=4)) == _rows(stored)
    one = clause_log.read(spark, root, ["d1"], buckets=4)
    assert _rows(one) == _rows(stored.filter("document_id = 'd1'"))
    one.explain("formatted")
    assert "PartitionFilters: [isnotnull(bucket" in capsys.readouterr().out


def test_log_batch_writes_only_what_came(spark, tmp_path):
    root = str(tmp_path / "log")
    many = spark.range(20000).select(F.col("id").cast("string").alias("document_id"), F.lit("h").alias("content_hash"), F.col("id").cast("string").alias("clause_id"),
                                     F.lit(1).alias("page_reference"), F.lit(0.5).alias("confidence"), F.col("id").alias("seq"))
    clause_log.apply_batch(many, root, 0, buckets=4)
    before = _files(tmp_path)
    clause_log.apply_batch(many.filter("seq = 77"), root, 1, buckets=4)
    assert len(_files(tmp_path) - before) == 1
    assert spark.read.parquet(f"{root}/data/batch=1").count() == 1
    clause_log.apply_batch(many.limit(0), root, 2, buckets=4)
    assert clause_log.state(spark, root).last_batch == 2 and len(clause_log.state(spark, root).folders) == 2
    found = clause_log.read(spark, root, ["77"], buckets=4).first()
    assert found["version"] == 2


def test_log_broken_batch_is_written_anew(spark, tmp_path):
    root = str(tmp_path / "log")
    batch = spark.createDataFrame([("d", "h", "c", 1, 0.5, 1)], ARRIVALS)
    dedup.upsert_clauses(batch).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{root}/data/batch=0/kind=delta")
    assert clause_log.read(spark, root) is None
    assert clause_log.apply_batch(batch, root, 0, buckets=4)
    assert [r["version"] for r in clause_log.read(spark, root).collect()] == [1]


def _feed(checkpoint, out, frame, mode):
    seen = []
    query = frame.writeStream.outputMode(mode).foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    out.extend(seen)


def _kept(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()


def test_admission_state_ends(spark, tmp_path):
    session = expiring.stateful_session(spark)
    source, mark, got = str(tmp_path / "in"), str(tmp_path / "mark"), []
    schema = "key string, request_id long, at double"
    first = [(f"k{i}", 10 * i + j, 1.7e9 + 100 * j) for i in range(20) for j in range(3)]
    late = [("k0", 900, 1.7e9 + 90000), ("new", 901, 1.7e9 + 90000)]
    for rows in (first, late):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        live = session.readStream.schema(schema).parquet(source)
        _feed(mark, got, expiring.admissions_stream(live, most=2, seconds=3600.0), "append")
        if rows is first:
            assert _kept(session, mark, "times") == 40  # two accepted times of each of 20 keys
    assert _kept(session, mark, "times") == 2
    want = streams.admissions(spark.createDataFrame(first + late, schema), most=2, seconds=3600.0)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_requests_at_the_epoch_are_late(spark, tmp_path):
    session, schema = expiring.stateful_session(spark), "key string, request_id long, at double"
    spark.createDataFrame([("k", 1, 0.0), ("k", 2, 0.001)], schema).write.parquet(str(tmp_path / "in"))
    got = []
    _feed(str(tmp_path / "mark"), got, expiring.admissions_stream(session.readStream.schema(schema).parquet(str(tmp_path / "in"))), "append")
    assert [r["request_id"] for r in got] == [2]


def test_job_state_ends(spark, tmp_path):
    session = expiring.stateful_session(spark)
    source, mark, got = str(tmp_path / "in"), str(tmp_path / "mark"), []
    schema = "job_id long, event_time timestamp, event_id long, decision string"
    at = lambda day: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("day") * 86400)
    table = lambda rows: spark.createDataFrame(rows, "job_id long, day double, event_id long, decision string").select("job_id", at("day").alias("event_time"), "event_id", "decision")
    first = [(1, 0.0, 1, "proceed"), (2, 0.0, 2, "revise"), (3, 0.0, 3, "reject"), (3, 0.1, 4, "proceed")]
    late = [(4, 9.0, 5, "revise"), (2, 9.0, 6, "proceed")]
    for rows in (first, late):
        table(rows).write.mode("append").parquet(source)
        live = session.readStream.schema(schema).parquet(source)
        _feed(mark, got, expiring.job_states(live, keep=86400.0), "update")
        if rows is first:
            assert _kept(session, mark, "job") == 3
    assert _kept(session, mark, "job") == 2
    last = {r["job_id"]: (r["outcome"], r["revisions"]) for r in got}
    assert last == {r["job_id"]: (r["outcome"], r["revisions"]) for r in workflow.job_outcomes(table(first + late)).collect()}


def _brute(starts, edges, most):
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            near[a].add(b)
    found = {}
    for origin in {o for o, _ in starts}:
        queue = deque((n, 0) for o, n in starts if o == origin and n is not None)
        while queue:
            node, hops = queue.popleft()
            if (origin, node) in found:
                continue
            found[origin, node] = hops
            if most is None or hops < most:
                queue.extend((n, hops + 1) for n in near[node])
    return sorted((o, n, h) for (o, n), h in found.items())


@pytest.mark.parametrize("most", [None, 0, 1, 3])
def test_reachable(spark, most):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(12)] + [(12, 0), (None, 1), (3, None)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    starts = [(1, 0), (1, 0), (2, 5), (2, 6), (3, 999), (3, None)]
    df = graph.reachable(spark.createDataFrame(starts, "origin int, node int"), spark.createDataFrame(edges, "src int, dst int"), most=most)
    assert sorted(map(tuple, df.collect())) == _brute(starts, edges, most)


def test_reachable_of_nothing(spark):
    none = spark.createDataFrame([], "origin int, node int")
    assert graph.reachable(none, spark.createDataFrame([(1, 2)], "src int, dst int")).count() == 0
    one = spark.createDataFrame([(1, 7)], "origin int, node int")
    assert [tuple(r) for r in graph.reachable(one, spark.createDataFrame([], "src int, dst int"), direction="both").collect()] == [(1, 7, 0)]


def test_parts_of_one_contract_are_dropped_before_the_walk(spark, sf_dir, monkeypatch):
    from contractlake.operators import graph
    from contractlake.plans import queries

    seen = []
    plain = graph.reachable
    monkeypatch.setattr(graph, "reachable", lambda starts, edges, **more: seen.append(edges) or plain(starts, edges, **more))
    queries.QUERIES["g7_linked_contracts"](spark, sf_dir)
    ends = seen[0].distinct().groupBy("dst").count()
    assert ends.filter("count < 2").isEmpty()
    held = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "b"), (None, "a"), (4, None)], "src long, dst string")
    assert sorted(map(tuple, graph.shared_ends(held).collect())) == [(2, "b"), (3, "b")]
