"""Access-log lines to columns and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.functions.columns import access_line_kind, filled, parse_access_line


def parse_access_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are access lines, as columns."""
    return lines.select(parse_access_line(F.col(column)).alias("x")).where("x is not null").select("x.*")


def access_log_rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that begin or end no call, with their columns and ``reject_code``; blank lines are none."""
    bad = lines.where((access_line_kind(F.col(column)) == "other") & filled(F.trim(F.col(column))).isNotNull())
    return bad.withColumn("reject_code", F.lit("NO_ACCESS_LINE"))


def access_log_levels(parsed: DataFrame, *per) -> DataFrame:
    """Calls, errors and durations by method and path, and by ``per`` before them."""
    return parsed.groupBy(*per, "method", "path").agg(F.count("*").alias("calls"), F.count_if(F.col("level") == "ERROR").alias("errors"), F.sum("duration_ms").cast("bigint").alias("duration_ms"))
