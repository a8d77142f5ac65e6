"""Per-job state over a stream of job events, with time-outs and retention by event time."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from herald.sources.writers import read_if_there

STATE = "status string, created_us bigint, started_us bigint, completed_us bigint, error string, last_us bigint, last_event bigint, error_us bigint, error_event bigint"
OUTPUT = "job_id bigint, status string, created_us bigint, started_us bigint, completed_us bigint, error string, timed_out boolean"
SHOWN = Row("job_id", "status", "created_us", "started_us", "completed_us", "error", "timed_out")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobProcessor(StatefulProcessor):
    """Folds events as the batch fold does; a job that runs too long fails, and may still complete.

    Every state ends: that of a finished or failed job after its retention, that of a job that never starts
    ``abandon_ms`` after its last event. An event that comes after that begins a new state. A job has one timer, whose
    time follows from its state, so none is looked up: each question to the state store costs more than the fold.
    """

    def __init__(self, time_out_ms: int = 300_000, retention_ms: int = 3_600_000, abandon_ms: int = 86_400_000) -> None:
        self.time_out_ms, self.retention_ms, self.abandon_ms = time_out_ms, retention_ms, abandon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _due(self, s: tuple) -> int:
        """When the job's timer is due, in milliseconds."""
        _, _, started, completed, _, last, *_ = s
        us, after_ms = (completed, self.retention_ms) if completed is not None else (started, self.time_out_ms) if started is not None else (last, self.abandon_ms)
        return -(-us // 1000) + after_ms

    def _out(self, job: int, s: tuple, timed_out: bool) -> Iterator[Row]:
        yield SHOWN(job, *s[:5], timed_out)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status = created = started = completed = error = last = last_event = error_us = error_event = None
        held = self.state.get()
        if held is not None:
            status, created, started, completed, error, last, last_event, error_us, error_event = held
        for _, _, us, event, what, why in rows:
            created = us if created is None else min(created, us)
            if what == "processing":
                started = us if started is None else max(started, us)
            if what in ("completed", "failed"):
                completed = us if completed is None else max(completed, us)
            if last is None or (us, event) >= (last, last_event):
                status, last, last_event = what, us, event
            if why is not None and (error_us is None or (us, event) >= (error_us, error_event)):
                error, error_us, error_event = why, us, event
        s = (status, created, started, completed, error, last, last_event, error_us, error_event)
        due = self._due(s)
        if held is None:
            self.handle.registerTimer(due)
        elif due != (before := self._due(held)):
            self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        self.state.update(s)
        yield from self._out(key[0], s, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is None:
            return
        if self._due(held) > expiredTimerInfo.getExpiryTimeInMs():  # a timer of a run with shorter times
            self.handle.registerTimer(self._due(held))
            return
        status, created, started, completed, error, *rest = held
        if completed is not None or started is None:  # kept long enough
            self.state.clear()
            return
        s = ("failed", created, started, started + 1000 * self.time_out_ms, error or "TIME_OUT", *rest)
        self.state.update(s)
        self.handle.registerTimer(self._due(s))
        yield from self._out(key[0], s, True)

    def close(self) -> None:
        pass


class LateEvents(StreamingQueryListener):
    """Adds up the events that came behind the watermark of a query and were left out, over all its micro-batches: a
    query's own ``recentProgress`` forgets all but the last ones. Add it to ``spark.streams`` before the query starts."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        found = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + found

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def of(self, query, wait: float = 60) -> int:
        """The number for a query that has ended; waits till its last progress has been told."""
        until = time.monotonic() + wait
        while str(query.id) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return self.dropped.get(str(query.id), 0)


def gate(events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", time_column: str = "event_ts") -> StreamingQuery:
    """Split a stream of events by its watermark, and stop: ``path``/accepted and ``path``/late (with ``reject_code``).

    The watermark of a micro-batch is the largest event time of those before it, less ``late``; an event at or behind it is
    late. It is noted at ``path``/marks before a batch is split, so a batch that is run again is split alike, and both
    tables have a folder a batch. A stateful stream over ``accepted`` with the same or a longer ``late`` leaves no event
    out: its own watermark, of fewer events, is never ahead of the gate's.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            marks = read_if_there(spark, f"{path}/marks")
            mark = None if marks is None else marks.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
            held.agg(F.max(time_column).alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")
            behind = F.lit(False) if mark is None else F.coalesce(F.col(time_column) <= F.lit(mark) - F.expr(f"interval {late}"), F.lit(False))
            held.where(~behind).write.mode("overwrite").parquet(f"{path}/accepted/batch_id={batch_id}")
            held.where(behind).withColumn("reject_code", F.lit("LATE")).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        finally:
            held.unpersist()

    return events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_job_state(events: DataFrame, late: str = "10 minutes", time_out_ms: int = 300_000, retention_ms: int = 3_600_000, abandon_ms: int = 86_400_000) -> DataFrame:
    """A stream of job states in update mode. The session's state store must be RocksDB (see PROVIDER).

    An event more than ``late`` behind the newest one is left out; ``LateEvents`` counts them, ``gate`` keeps their rows."""
    timed = events.withWatermark("event_ts", late).select("job_id", "event_ts", F.unix_micros("event_ts").alias("event_us"), "event_id", "status", "error")
    states = timed.groupBy("job_id").transformWithState(JobProcessor(time_out_ms, retention_ms, abandon_ms), OUTPUT, "Update", "EventTime")
    at = lambda c: F.timestamp_micros(f"{c}_us").alias(f"{c}_at")
    return states.select("job_id", "status", at("created"), at("started"), at("completed"), "error", "timed_out")
