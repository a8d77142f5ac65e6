"""Batches meet the provider's answers, and roll up to requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.functions.columns import count_or_zero

NO_RESPONSE = "NO_RESPONSE"


def reconcile_batches(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Every batch beside its answer (code, message, info), if there is one."""
    return batches.join(responses, ["request_id", "batch_index"], "left")


def batch_outcome(reconciled: DataFrame, *kept: str) -> DataFrame:
    """request_id, batch_index, batch_size, the ``kept`` columns, success, success_count, sms_count, fail_count, actual_cost, error."""
    ok = F.coalesce((F.col("code") == 0) & F.col("info").isNotNull(), F.lit(False))
    zero = F.lit(0).cast("bigint")
    return reconciled.select(
        "request_id", "batch_index", "batch_size", *kept, ok.alias("success"), F.when(ok, count_or_zero(F.col("info.scnt"))).otherwise(zero).alias("success_count"), zero.alias("sms_count"),
        F.when(ok, count_or_zero(F.col("info.fcnt"))).otherwise(F.col("batch_size")).alias("fail_count"),
        F.when(ok, F.coalesce(F.col("info.total").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).otherwise(F.lit(0).cast("decimal(18,2)")).alias("actual_cost"),
        F.when(~ok, F.coalesce("message", F.lit(NO_RESPONSE))).alias("error"),
    )


def rollup_requests(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """request_id, recipient_count, batch_count, success, and the sums over its batches.

    A request without a template has no batches, failed, and all its recipients failed; one with a template and no
    batches succeeded.
    """
    per = outcomes.groupBy("request_id").agg(
        F.count("*").alias("batch_count"), F.bool_and("success").alias("_all"), F.sum("success_count").alias("success_count"), F.sum("sms_count").alias("sms_count"),
        F.sum("fail_count").alias("fail_count"), F.sum("actual_cost").cast("decimal(18,2)").alias("actual_cost"),
    )
    return rolled_up(requests.join(per, "request_id", "left"), requests.columns)


def rolled_up(joined: DataFrame, columns: list[str], *kept: str) -> DataFrame:
    """The requests' columns and outcome, of requests beside the sums over their batches (null where they have none)."""
    zero = lambda c: count_or_zero(F.col(c)).alias(c)
    return joined.select(
        *columns, *kept, zero("batch_count"), F.when(F.col("template_found"), F.coalesce("_all", F.lit(True))).otherwise(False).alias("success"), zero("success_count"), zero("sms_count"),
        F.when(F.col("template_found"), count_or_zero(F.col("fail_count"))).otherwise(F.col("recipient_count")).alias("fail_count"), F.coalesce("actual_cost", F.lit(0).cast("decimal(18,2)")).alias("actual_cost"),
    )


def collect_batch_results(outcomes: DataFrame) -> DataFrame:
    """request_id, batch_results: the batches in order (one for each 500 recipients)."""
    return outcomes.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("batch_index", "success", "success_count", "fail_count", "actual_cost", "error"))).alias("batch_results"))


def project_send_summary(rolled: DataFrame) -> DataFrame:
    return rolled.select("request_id", "success", "recipient_count", "success_count", "sms_count", "fail_count", "total_cost", "batch_count")
