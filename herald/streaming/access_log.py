"""The access log as a stream: counts per window of time, and the lines that are no access lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herald.operators.access_log import access_log_levels, access_log_rejects, parse_access_log


def windowed_levels(lines: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, method, path, calls, errors, duration_ms: one row when a window ends, by event time (append mode)."""
    timed = parse_access_log(lines).withWatermark("ts", late)
    counted = access_log_levels(timed, F.window("ts", width).alias("window"))
    return counted.select(F.col("window.start").alias("window_start"), "method", "path", "calls", "errors", "duration_ms")


def stream_access_log(lines: DataFrame, path: str, checkpoint: str, width: str = "1 hour", late: str = "10 minutes") -> list[StreamingQuery]:
    """Start reading what is there and stop: ``path``/levels has each window once it has ended, ``path``/rejects the lines
    that begin or end no call. Both sinks are exactly-once file sinks."""
    sink = lambda rows, name: rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    return [sink(windowed_levels(lines, width, late), "levels"), sink(access_log_rejects(lines), "rejects")]
