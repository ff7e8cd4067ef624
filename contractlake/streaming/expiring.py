"""Keyed streams whose state ends: event-time timers clear a key once nothing that may still come can need it.

They need the RocksDB state store: start them in `stateful_session(spark)`. Batch forms with the same rows are in streams and workflow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contractlake.streaming.streams import ADMITTED, JOB, LATE, _admit

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = {"proceed": "finalized", "reject": "rejected", "escalate": "escalated"}


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the RocksDB state store; the settings of other queries stay as they are."""
    new = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        new.conf.set(name, spark.conf.get(name))
    new.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return new


class _Expiring(StatefulProcessor):
    """Keeps one timer a key: the newest; when it fires, the key's state goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _clear(self) -> None:
        raise NotImplementedError

    def _end_at(self, millis: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(millis)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        return iter(())

    def close(self) -> None:
        pass


class _Admissions(_Expiring):
    def __init__(self, most: int, seconds: float) -> None:
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getListState("times", "at double")

    def _clear(self) -> None:
        self.times.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = [t for (t,) in self.times.get()] if self.times.exists() else []
        all_rows = pd.concat(list(rows)).sort_values(["at", "request_id"])
        out = []
        for at in all_rows["at"]:
            times, ok = _admit(times, at, self.most, self.seconds)
            out.append(ok)
        if times:
            self.times.put([(float(t),) for t in times])
            self._end_at(int((times[-1] + self.seconds) * 1000) + 1)
        elif self.times.exists():
            self.times.clear()
        yield all_rows.assign(accepted=out)[["key", "request_id", "at", "accepted"]]


def admissions_stream(requests: DataFrame, *, most: int = 30, seconds: float = 60.0, late: str = LATE) -> DataFrame:
    """Stream of requests (key, request_id, at in seconds), each accepted if fewer than `most` of its key were in the last `seconds`.

    The state of a key is its accepted times, at most `most`; it goes when the watermark is `seconds` past the last of them. Requests
    later than `late` are dropped, as are those at or before the epoch, where a stream's watermark begins. The requests of a key that one micro-batch brings are held together.
    """
    timed = requests.select("key", "request_id", "at", F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("time"))
    grouped = timed.withWatermark("time", late).groupBy("key")
    return grouped.transformWithStateInPandas(_Admissions(most, seconds), ADMITTED, "append", "eventTime")


class _Jobs(_Expiring):
    def __init__(self, revisions: int, keep: float) -> None:
        self.revisions, self.keep = revisions, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "outcome string, count int")

    def _clear(self) -> None:
        self.job.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        outcome, count = self.job.get() if self.job.exists() else ("open", 0)
        all_rows = pd.concat(list(rows)).sort_values(["event_time", "event_id"])
        was_open = outcome == "open"
        for decision in all_rows["decision"]:
            if outcome != "open":
                break
            count += decision == "revise"
            outcome = OUTCOMES.get(decision, "escalated" if count > self.revisions else "open")
        self.job.update((outcome, int(count)))
        if was_open and outcome != "open":
            self._end_at(int(all_rows["event_time"].max().timestamp() * 1000 + self.keep * 1000))
        yield pd.DataFrame({"job_id": [key[0]], "outcome": [outcome], "revisions": [min(int(count), self.revisions)]})


def job_states(events: DataFrame, *, revisions: int = 3, keep: float = 86400.0, late: str = LATE) -> DataFrame:
    """Stream of checkpoint decisions (job_id, event_time, event_id, decision) to the state of each job whenever events of it come.

    Open jobs are kept. One that has ended is kept for `keep` seconds of event time, so that decisions which follow its end still find it
    closed, and then goes; a decision that comes even later would open the job again, so `keep` must exceed the longest delay.
    """
    rows = events.select("job_id", F.col("event_time").cast("timestamp").alias("event_time"), "event_id", "decision").withWatermark("event_time", late)
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(revisions, keep), JOB, "update", "eventTime")
