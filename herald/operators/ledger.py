"""Ledger rows, one per finished request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herald.functions.columns import first_filled


def build_ledger_row(settled: DataFrame, batch_results: DataFrame, sent_at: Column) -> DataFrame:
    """A finished request's row, with its batches' results in order and the date by which the ledger is partitioned.

    Name and title are the template's name, or its code where that is empty; ``content`` is the template's text.
    Recipients are a child table keyed by request_id."""
    name = first_filled("template_name", "template_code")
    rows = settled.join(batch_results, "request_id", "left").withColumn("sent_at", sent_at)
    return rows.select(
        "request_id", "union_id", "sender_id", "sender_alias", "channel_name", "template_code", name.alias("template_name"), name.alias("title"), F.col("template_content").alias("content"), "notice_id",
        "recipient_count", "success_count", "sms_count", "fail_count", "total_cost", "actual_cost", "success", F.coalesce("batch_results", F.array().cast(batch_results.schema["batch_results"].dataType)).alias("batch_results"),
        "sent_at", F.to_date("sent_at").alias("sent_date"),
    )
