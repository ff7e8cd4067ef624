"""Streams over the append-only logs. Each function takes a streaming or a batch DataFrame; batch runs give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contractlake.functions import columns as C

LATE = "10 minutes"


def action_counts(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events (event_time, action) by tumbling or sliding window and action; later ones than `late` are dropped."""
    window = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    counted = events.withWatermark("event_time", late).groupBy(window.alias("w"), "action").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "action", "n")


def session_counts(events: DataFrame, *, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions of each job: runs of events no further apart than the gap."""
    grouped = events.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), "job_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("job_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def new_documents(uploads: DataFrame, *, late: str = LATE) -> DataFrame:
    """Uploads (document_id, text, event_time) without repeats of the same content."""
    hashed = uploads.withColumn("content_hash", C.content_hash(F.col("text")))
    if uploads.isStreaming:
        return hashed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["document_id", "content_hash"])
    return hashed.dropDuplicates(["document_id", "content_hash"])


def upsert_batches(stream: DataFrame, path: str, checkpoint: str):
    """Writes clause arrivals (as dedup.upsert_clauses takes them) as merged tables, one folder a batch; the newest holds all.

    Each batch rewrites the table: for small tables that others read as plain Parquet. `log_batches` writes only what came.
    """
    from contractlake.operators import dedup

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = dedup.upsert_clauses(batch)
        if number:
            new = dedup.merge_clauses(spark.read.parquet(f"{path}/batch={number - 1}"), batch)
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_batches(stream: DataFrame, path: str, checkpoint: str, *, buckets: int = 64):
    """Clause arrivals (as dedup.upsert_clauses takes them) into the log of deltas at `path`, read by clause_log.read."""
    from contractlake.streaming import clause_log

    def append(batch: DataFrame, number: int) -> None:
        clause_log.apply_batch(batch, path, number, buckets=buckets)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ADMITTED = "key string, request_id long, at double, accepted boolean"


def _admit(times: list[float], at: float, most: int, seconds: float) -> tuple[list[float], bool]:
    times = [t for t in times if at - t <= seconds]
    return (times + [at], True) if len(times) < most else (times, False)


def admissions(requests: DataFrame, *, most: int = 30, seconds: float = 60.0) -> DataFrame:
    """Batch form: a request (key, request_id, at in seconds) is accepted if fewer than `most` were in the last `seconds`.

    The requests of a key pass in order, a batch at a time; only its last accepted times are held.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = None, []
        for rows in parts:
            out = []
            for key, at in zip(rows["key"], rows["at"]):
                if key != last:
                    last, times = key, []
                times, ok = _admit(times, at, most, seconds)
                out.append(ok)
            yield rows.assign(accepted=out)

    asked = requests.select("key", "request_id", "at").repartition("key").sortWithinPartitions("key", "at", "request_id")
    return asked.mapInPandas(run, ADMITTED)


def admissions_stream(requests: DataFrame, *, most: int = 30, seconds: float = 60.0) -> DataFrame:
    """Stream form: the state of a key is the times of its accepted requests, at most `most`."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for rows in [pd.concat(list(parts)).sort_values(["at", "request_id"])]:
            out = []
            for at in rows["at"]:
                times, ok = _admit(times, at, most, seconds)
                out.append(ok)
            yield rows.assign(accepted=out)[["key", "request_id", "at", "accepted"]]
        state.update((times,))

    return requests.groupBy("key").applyInPandasWithState(run, ADMITTED, "times array<double>", "append", GroupStateTimeout.NoTimeout)


def window_load(requests: DataFrame, *, seconds: float = 60.0) -> DataFrame:
    """Adds `load`: requests of the key in the last `seconds`, this one included."""
    frame = f"PARTITION BY key ORDER BY at RANGE BETWEEN {float(seconds)}D PRECEDING AND CURRENT ROW"
    return requests.withColumn("load", F.expr(f"count(1) OVER ({frame})"))


JOB = "job_id long, outcome string, revisions int"


def job_states(events: DataFrame, *, revisions: int = 3) -> DataFrame:
    """Stream of checkpoint decisions (job_id, event_time, event_id, decision) to the state of each job whenever it changes."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outcome, count = state.get if state.exists else ("open", 0)
        rows = pd.concat(list(parts)).sort_values(["event_time", "event_id"])
        for decision in rows["decision"]:
            if outcome != "open":
                break
            count += decision == "revise"
            outcome = {"proceed": "finalized", "reject": "rejected", "escalate": "escalated"}.get(decision, "escalated" if count > revisions else "open")
        state.update((outcome, int(count)))
        yield pd.DataFrame({"job_id": [key[0]], "outcome": [outcome], "revisions": [min(int(count), revisions)]})

    return events.groupBy("job_id").applyInPandasWithState(run, JOB, "outcome string, count int", "update", GroupStateTimeout.NoTimeout)


def enriched(events: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Each event with the columns of a static dimension."""
    return events.join(dimension, keys, "left")
