"""Lookups as joins: a key that occurs exactly once resolves, any other is a miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.functions.columns import filled, first_filled, key_name

DEFAULT_ALIAS = "default"
DEFAULT_CHANNEL = "default_channel"


def unique_by_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once. Catalyst broadcasts the result where its size allows."""
    others = [c for c in rows.columns if c != key]
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
    return counted.where("_n = 1").drop("_n")


def resolve_template(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds the template's columns and ``template_found``."""
    return requests.join(unique_by_key(templates, "template_code").withColumn("_hit", F.lit(True)), "template_code", "left").withColumn("template_found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def resolve_sender_alias(requests: DataFrame, aliases: DataFrame, default: str = DEFAULT_ALIAS) -> DataFrame:
    """Adds ``sender_alias`` and ``is_default`` (no alias, or an empty one, under the tenant's key name)."""
    keys = unique_by_key(aliases, "name").select(F.col("name").alias("_name"), filled("key_alias").alias("_alias"))
    hit = requests.join(keys, key_name(F.col("union_id")) == F.col("_name"), "left")
    return hit.withColumns({"sender_alias": F.coalesce("_alias", F.lit(default)), "is_default": F.col("_alias").isNull()}).drop("_name", "_alias")


def resolve_channel(resolved: DataFrame, channels: DataFrame, default: str = DEFAULT_CHANNEL) -> DataFrame:
    """Adds ``channel_name``: the tenant's, if its own key was found and the channel is not empty."""
    named = unique_by_key(channels, "id").select(F.col("id").alias("_id"), F.col("kakao_channel_id").alias("_channel"))
    hit = resolved.join(named, F.col("union_id") == F.col("_id"), "left")
    return hit.withColumn("channel_name", F.when(F.col("is_default"), default).otherwise(F.coalesce(first_filled("_channel"), F.lit(default)))).drop("_id", "_channel")


def attach_prices(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Every row beside the one row of the price pivot."""
    return rows.crossJoin(F.broadcast(prices))  # one row, by construction
