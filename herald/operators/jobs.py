"""Job state from events: folding, gauges, depth, time-outs, retention, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUNNING = ("pending", "processing")
FINISHED = ("completed", "failed")
QUEUE_LIMIT = 100
TIME_OUT = "5 minutes"
RETENTION = "1 hour"
#: Rows of an hour up to which it is one range of the depth series, and ranges of a busier one.
RANGE, CUTS = 1_000_000, 512
#: Busy hours whose edges may be broadcast (4 KB each).
BROADCAST_HOURS = 5000


def fold_job_state(events: DataFrame) -> DataFrame:
    """One row per job: last status, first event, last start, last end; an error stays once it is set."""
    at = F.struct("event_ts", "event_id")
    when = lambda *s: F.max(F.when(F.col("status").isin(*s), F.col("event_ts")))
    last_error = F.max(F.when(F.col("error").isNotNull(), F.struct("event_ts", "event_id", "error")))["error"]
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"), F.min("event_ts").alias("created_at"), when("processing").alias("started_at"), when(*FINISHED).alias("completed_at"), last_error.alias("error")
    )


def queue_gauge(state: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """One row: waiting, running, completed, failed, is_full, available."""
    of = lambda s: F.count_if(F.col("status") == s)
    counted = state.agg(of("pending").alias("waiting"), of("processing").alias("running"), of("completed").alias("completed"), of("failed").alias("failed"))
    used = F.col("waiting") + F.col("running")
    return counted.withColumns({"is_full": used >= limit, "available": F.greatest(F.lit(limit) - used, F.lit(0).cast("bigint"))})


def depth_ranges(rows: DataFrame, most: int = RANGE) -> DataFrame:
    """Adds ``_hour`` and ``_range``: ranges of (event_ts, event_id), in order. An hour of more than ``most`` rows is cut at
    approximate quantiles of its rows, by time and, within one time, by event id, so one instant may be many ranges.

    Busy hours are counted first (a job of partial counts by hour). Their edges are broadcast up to BROADCAST_HOURS hours;
    beyond that the rows are joined by shuffle, where Spark splits a skewed hour."""
    hourly = rows.withColumn("_hour", F.date_trunc("hour", "event_ts"))
    hot = hourly.groupBy("_hour").agg(F.count("*").alias("_n"), F.min("event_id").alias("_lo"), F.max("event_id").alias("_hi")).where(F.col("_n") > most).drop("_n")
    busy = hot.count()
    if not busy:
        return hourly.withColumn("_range", F.lit(0))
    held = (lambda rows: F.broadcast(rows)) if busy <= BROADCAST_HOURS else (lambda rows: rows)
    micros = F.unix_micros(F.col("event_ts").cast("timestamp")) - F.unix_micros(F.col("_hour").cast("timestamp"))
    key = micros + (F.col("event_id").cast("double") - F.col("_lo")) / (F.col("_hi").cast("double") - F.col("_lo") + 1)  # never falls in the order of (event_ts, event_id)
    edges = hourly.join(held(hot), "_hour").groupBy("_hour").agg(F.percentile_approx(key, [k / CUTS for k in range(1, CUTS)], 10 * CUTS).alias("_edges"))
    known = hourly.join(held(hot.join(edges, "_hour")), "_hour", "left")
    jump = lambda acc, step: F.when((F.get("_edges", acc + step - 1) <= key).eqNullSafe(True), acc + step).otherwise(acc)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(CUTS.bit_length()))])
    return known.withColumn("_range", F.when(F.col("_edges").isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), jump))).drop("_lo", "_hi", "_edges")


def queue_depth_series(events: DataFrame, limit: int = QUEUE_LIMIT, most: int = RANGE) -> DataFrame:
    """event_ts, event_id, job_id, delta, depth, is_full: +1 at a job's first event, -1 at its last finish.

    Deltas are summed per range of time (an hour, or a part of a busy one), ranges are prefix-summed (one row each), and
    rows are summed inside their range.
    """
    key = F.struct("event_ts", "event_id")
    ends = events.groupBy("job_id").agg(F.min(key).alias("up"), F.max(F.when(F.col("status").isin(*FINISHED), key)).alias("down"))
    deltas = ends.select("job_id", F.explode(F.array(F.struct(F.col("up").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("down").alias("at"), F.lit(-1).alias("delta")))).alias("x")).where("x.at is not null")
    rows = depth_ranges(deltas.select("x.at.event_ts", "x.at.event_id", "job_id", "x.delta"), most)
    part = ["_hour", "_range"]
    before = rows.groupBy(*part).agg(F.sum("delta").alias("_sum")).select(*part, F.coalesce(F.sum("_sum").over(W.orderBy(*part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum("delta").over(W.partitionBy(*part).orderBy("event_ts", "event_id", F.col("delta").desc()).rowsBetween(W.unboundedPreceding, 0))
    depth = rows.withColumn("_in", inside).join(before, part).withColumn("depth", (F.col("_base") + F.col("_in")).cast("bigint"))
    return depth.select("event_ts", "event_id", "job_id", "delta", "depth").withColumn("is_full", F.col("depth") >= limit)


def job_timeout(state: DataFrame, as_of: Column, limit: str = TIME_OUT) -> DataFrame:
    """Adds ``timed_out``: ran (or runs, at ``as_of``) longer than the limit."""
    end = F.coalesce("completed_at", as_of)
    return state.withColumn("timed_out", F.coalesce(end > F.col("started_at") + F.expr(f"interval {limit}"), F.lit(False)))


def expire_completed_jobs(state: DataFrame, as_of: Column, keep: str = RETENTION) -> DataFrame:
    """Jobs that have not finished, or finished no longer ago than the limit (exactly that long ago is kept)."""
    return state.where(F.col("completed_at").isNull() | (F.col("completed_at") >= as_of - F.expr(f"interval {keep}")))


def lookup_jobs(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """Wanted ids beside their state; ``lookup_error`` is JOB_NOT_FOUND on a miss."""
    hit = wanted.join(state.withColumn("_hit", F.lit(1)), "job_id", "left")
    return hit.withColumn("lookup_error", F.when(F.col("_hit").isNull(), "JOB_NOT_FOUND")).drop("_hit")


def project_job_status(state: DataFrame, results: list[str]) -> DataFrame:
    """job_id, status, times, error, and the results, which only a completed job shows."""
    shown = [F.when(F.col("status") == "completed", F.col(c)).alias(c) for c in results]
    return state.select("job_id", "status", "created_at", "started_at", "completed_at", "error", *shown)
