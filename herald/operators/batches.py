"""Batches of the provider's size, their failover flag, and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herald.functions.columns import filled

BATCH = 500
#: Positions of one range; a request's ranges are counted first, so no window holds a whole campaign.
RANGE = 100_000


def _placed(rows: DataFrame, place: Column, size: int) -> DataFrame:
    return rows.withColumns({"batch_index": F.floor(place / size).cast("bigint"), "slot": (place % size + 1).cast("bigint")})


def assign_batches(recipients: DataFrame, size: int = BATCH, span: int = RANGE) -> DataFrame:
    """Adds ``batch_index`` (from 0) and ``slot`` (from 1) in the order of ``seq``; gaps in seq are closed.

    Rows are counted per request and range of seq, and numbered inside a range: a campaign of any size is many tasks.
    """
    rows = recipients.withColumn("_range", F.floor(F.col("seq") / span))
    counts = rows.groupBy("request_id", "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy("request_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("request_id", "_range").orderBy("seq")) - 1
    numbered = rows.withColumn("_at", inside).join(before, ["request_id", "_range"])
    return _placed(numbered, F.col("_base") + F.col("_at"), size).drop("_range", "_at", "_base")


def assign_batches_nested(exploded: DataFrame, size: int = BATCH) -> DataFrame:
    """The same for rows exploded with their position: arithmetic alone, no shuffle."""
    return _placed(exploded, F.col("seq"), size)


def chunk_array(items: Column, size: int = BATCH) -> Column:
    """Array of consecutive slices; an empty array has none, a null one is null."""
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / size).cast("int") - 1), lambda i: F.slice(items, i * size + 1, size))
    return F.when(F.size(items) > 0, cut).when(items.isNotNull(), F.slice(F.array(items), 1, 0))


def batch_failover_flag(batched: DataFrame) -> DataFrame:
    """request_id, batch_index, failover (Y or N): the template's flag, or any recipient of the batch with a failover message."""
    on = F.coalesce(F.bool_or(F.coalesce("use_failover", F.lit(False)) | filled("failover_message").isNotNull()), F.lit(False))
    return batched.groupBy("request_id", "batch_index").agg(F.when(on, "Y").otherwise("N").alias("failover"))


def outbox_params(rendered: DataFrame, flags: DataFrame) -> DataFrame:
    """Long form: (request_id, batch_index, slot, param, value), absent values left out; slot 0 carries the batch's flag."""
    named = ("receiver", "subject", "emtitle", "message", "button", "fsubject", "fmessage")
    pairs = F.explode(F.array(*[F.struct(F.concat_ws("_", F.lit(p), F.col("slot").cast("string")).alias("param"), F.col(p).alias("value")) for p in named])).alias("x")
    slots = rendered.select("request_id", "batch_index", "slot", pairs).select("request_id", "batch_index", "slot", "x.param", "x.value").where("value is not null")
    return slots.unionByName(flags.select("request_id", "batch_index", F.lit(0).cast("bigint").alias("slot"), F.lit("failover").alias("param"), F.col("failover").alias("value")))


def outbox_wide(params: DataFrame) -> DataFrame:
    """One row per batch with its ordered parameters (at most 7 * BATCH + 1)."""
    return params.groupBy("request_id", "batch_index").agg(F.array_sort(F.collect_list(F.struct("slot", "param", "value"))).alias("params"))
