"""Requests and recipients: validation, size guard, positions, telephone numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.functions.columns import filled, is_valid_phone, normalize_phone

SYNC_LIMIT = 500


def validate_requests(requests: DataFrame, count: str = "recipient_count") -> DataFrame:
    """Adds ``reject_code``: INVALID_PARAMS where tenant, template or recipients are absent; null where accepted."""
    absent = filled("union_id").isNull() | filled("template_code").isNull() | (F.coalesce(F.col(count), F.lit(0)) == 0)
    return requests.withColumn("reject_code", F.when(absent, "INVALID_PARAMS"))


def sync_size_guard(validated: DataFrame, count: str = "recipient_count", limit: int = SYNC_LIMIT) -> DataFrame:
    """After validation: more recipients than a synchronous request may have is TOO_MANY_RECIPIENTS."""
    return validated.withColumn("reject_code", F.coalesce("reject_code", F.when(F.col(count) > limit, "TOO_MANY_RECIPIENTS")))


def recipient_count(recipients: DataFrame) -> DataFrame:
    return recipients.groupBy("request_id").agg(F.count("*").alias("recipient_count"))


def explode_recipients(requests: DataFrame) -> DataFrame:
    """One row per recipient of the nested array, with its position ``seq``."""
    return requests.select("request_id", F.posexplode("recipients").alias("seq", "recipient")).select("request_id", F.col("seq").cast("bigint").alias("seq"), "recipient.*")


def with_phones(recipients: DataFrame) -> DataFrame:
    """Adds ``receiver`` (normalized) and ``valid_phone``."""
    return recipients.withColumns({"receiver": normalize_phone(F.col("phone_number")), "valid_phone": is_valid_phone(F.col("phone_number"))})


def filter_valid_phones(recipients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recipients with a valid mobile number, and the others."""
    marked = with_phones(recipients)
    return marked.where("valid_phone"), marked.where("not valid_phone")


def split_null_phones(recipients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recipients that can be rendered, and rejects without any number (one of those must not fail its request)."""
    return recipients.where("phone_number is not null"), recipients.where("phone_number is null").withColumn("reject_code", F.lit("NO_PHONE"))
