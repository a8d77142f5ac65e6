"""Prices and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.functions.columns import flat_cost, priced_cost

#: Unit prices of message types that the list lacks. Fixed values.
DEFAULTS = {"KAKAO": 15, "SMS": 20, "LMS": 50}


def price_pivot(prices: DataFrame) -> DataFrame:
    """One row (kakao_price, sms_price, lms_price); a missing type or a null price takes the default."""
    listed = lambda t: F.max(F.when(F.col("message_type") == t, F.col("unit_price"))).cast("decimal(18,2)")
    return prices.agg(*[F.coalesce(listed(t), F.lit(d).cast("decimal(18,2)")).alias(f"{t.lower()}_price") for t, d in DEFAULTS.items()])


def with_flat_cost(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("total_cost", flat_cost(F.col("success_count"), F.col("sms_count")))


def with_priced_cost(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("total_cost", priced_cost(F.col("success_count"), F.col("sms_count"), F.col("kakao_price"), F.col("sms_price")))
