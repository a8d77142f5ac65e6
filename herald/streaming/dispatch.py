"""Continuous dispatch: requests are read as a stream, resolved against the newest lookups, rendered and put into the outbox.

A request is resolved before its recipients are exploded, and the flags of its batches are taken from the nested array, so
no recipient is shuffled before the outbox gathers batches. A request may come in parts, so that no line, and no task, holds
a whole campaign: what the parts have to know of each other (counts, flags of shared batches) are narrow rows. A micro-batch is read once, held on the executors (memory, then
their disks; what is lost is read again) and serves both sinks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herald.functions.columns import filled, job_id, normalize_phone, ordered_variables
from herald.operators import batches, rendering, requests, resolve
from herald.plans.jobs import TEMPLATE_COLUMNS
from herald.sources import readers, writers

#: Templates, key aliases and channels.
Lookups = tuple[DataFrame, DataFrame, DataFrame]
#: Parts of requests whose narrow rows may be broadcast (some 200 bytes each).
BROADCAST_PARTS = 100_000


def parts_of_requests(rows: DataFrame) -> DataFrame:
    """Of the lines that are parts of a request, narrow rows: ingest_file, ingest_line, ``total`` (recipients of the
    request), ``lead`` (its first part), ``base`` (recipients with a number in the parts before) and ``fails`` (for each
    batch that the part reaches, whether any recipient of the batch, in whichever part, has a failover message)."""
    sendable = F.filter("recipients", lambda r: r["phoneNumber"].isNotNull())
    failing = F.filter(F.transform(sendable, lambda r, i: F.when(filled(r["failoverMessage"]).isNotNull(), i)), lambda i: i.isNotNull())
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    narrow = rows.where("request_key is not null").select("ingest_file", "request_key", "ingest_line", "first_seq", size(F.col("recipients")).alias("n"), size(sendable).alias("ok"), failing.alias("at"))
    request = W.partitionBy("ingest_file", "request_key")
    ordered = request.orderBy("first_seq", "ingest_line")
    based = narrow.select(
        "ingest_file", "request_key", "ingest_line", "ok", "at", F.sum("n").over(request).alias("total"), (F.row_number().over(ordered) == 1).alias("lead"),
        F.coalesce(F.sum("ok").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint")).alias("base"),
    )
    batch = lambda place: F.floor(place / batches.BATCH).cast("bigint")
    reached = F.when(F.col("ok") > 0, F.sequence(batch(F.col("base")), batch(F.col("base") + F.col("ok") - 1)))
    hit = F.array_distinct(F.transform("at", lambda i: batch(F.col("base") + i)))
    each = based.select("ingest_file", "request_key", "ingest_line", "total", "lead", "base", hit.alias("hit"), F.explode_outer(reached).alias("batch"))
    on = F.max(F.coalesce(F.array_contains("hit", F.col("batch")), F.lit(False))).over(W.partitionBy("ingest_file", "request_key", "batch"))
    found = each.withColumn("on", on).groupBy("ingest_file", "ingest_line").agg(
        *[F.first(c).alias(c) for c in ("total", "lead", "base")], F.array_sort(F.collect_list(F.when(F.col("batch").isNotNull(), F.struct("batch", "on")))).alias("fails"))
    return found.withColumn("fails", F.transform("fails", lambda x: x["on"]))


def checked(rows: DataFrame) -> DataFrame:
    """Requests with request_id (of file and line, or of file and key for parts: two equal requests differ, a replay does
    not) and reject_code; beside a part's own columns stand those of ``parts_of_requests``."""
    parts = parts_of_requests(rows)
    beside = rows.join(F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts, ["ingest_file", "ingest_line"], "left")
    counted = beside.withColumns({"recipient_count": F.coalesce("total", F.size("recipients"), F.lit(0)), "lead": F.coalesce("lead", F.lit(True)), "base": F.coalesce("base", F.lit(0).cast("bigint"))}).drop("total")
    judged = requests.validate_requests(counted).withColumn("reject_code", F.when(F.col("corrupt_record").isNotNull(), "CORRUPT").otherwise(F.col("reject_code")))
    place = job_id(F.col("ingest_file"), F.col("ingest_line"))
    return judged.withColumn("request_id", F.when(F.col("request_key").isNull(), place).otherwise(job_id(F.col("ingest_file"), F.lit("key"), F.col("request_key"))))


def resolved(judged: DataFrame, lookups: Lookups) -> DataFrame:
    """Accepted requests (or parts) that have a template, with it, sender and channel, and ``flags``, the failover flag of
    each batch that they reach.

    Recipients without a number are left out before positions are given, so slots have no gaps."""
    templates, aliases, channels = lookups
    # the first three say no more than the last, but of a line alone, so they are judged before the line meets its parts
    alone = F.col("corrupt_record").isNull() & filled("union_id").isNotNull() & filled("template_code").isNotNull()
    accepted = judged.where(alone).where("reject_code is null").withColumn("recipients", F.filter("recipients", lambda r: r["phoneNumber"].isNotNull()))
    found = resolve.resolve_template(accepted, templates).where("template_found")
    named = resolve.resolve_channel(resolve.resolve_sender_alias(found, aliases), channels)
    own = F.transform(batches.chunk_array(F.col("recipients")), lambda part: F.exists(part, lambda r: filled(r["failoverMessage"]).isNotNull()))
    on = lambda x: F.when(F.coalesce("use_failover", F.lit(False)) | x, "Y").otherwise("N")
    return named.withColumn("flags", F.transform(F.coalesce("fails", own), on)).drop("fails")


def outbox(found: DataFrame) -> DataFrame:
    """The outbox of resolved requests: long form. No shuffle."""
    kept = [c for c in TEMPLATE_COLUMNS if c in found.columns]
    before = F.floor(F.col("base") / batches.BATCH).cast("bigint")
    each = found.select("request_id", *kept, "flags", "base", before.alias("before"), F.posexplode("recipients").alias("seq", "r"))
    placed = batches.assign_batches_nested(each.withColumn("seq", F.col("base") + F.col("seq")))
    flat = placed.select(
        "request_id", *kept, "seq", "batch_index", "slot", F.get("flags", (F.col("batch_index") - F.col("before")).cast("int")).alias("failover"), F.col("r.phoneNumber").alias("phone_number"), F.col("r.variables").alias("variables"),
        F.col("r.content").alias("content"), F.col("r.buttons").alias("buttons"), F.col("r.emtitle").alias("emtitle"), F.col("r.failoverSubject").alias("failover_subject"), F.col("r.failoverMessage").alias("failover_message"),
    )
    rendered = rendering.render_flagged(flat.withColumn("receiver", normalize_phone(F.col("phone_number"))), ordered_variables(F.col("variables")))
    # a batch's flag comes from the part that the batch begins in
    begun = found.select("request_id", "base", before.alias("before"), F.posexplode("flags").alias("at", "failover")).withColumn("batch_index", F.col("before") + F.col("at")).where(F.col("batch_index") * batches.BATCH >= F.col("base"))
    return batches.outbox_params(rendered, begun.select("request_id", "batch_index", "failover"))


def rejects(judged: DataFrame) -> DataFrame:
    """ingest_file, ingest_line, seq (of a recipient, else null), reject_code: lines that do not parse, requests that are
    not valid (once, by their first part), recipients without a number."""
    whole = judged.where("reject_code is not null and lead").select("ingest_file", "ingest_line", F.lit(None).cast("bigint").alias("seq"), "reject_code")
    each = judged.where("reject_code is null").select("ingest_file", "ingest_line", "first_seq", F.posexplode("recipients").alias("seq", "r")).where("r.phoneNumber is null")
    return whole.union(each.select("ingest_file", "ingest_line", F.col("first_seq") + F.col("seq"), F.lit("NO_PHONE")))


def newest_lookups(spark: SparkSession, catalogue: str, aliases: str, channels: str) -> Callable[[str], Lookups]:
    """Lookups of a micro-batch: the catalogue's newest snapshot as the batch begins, aliases and channels as they are then.

    The version that a batch uses is noted first (at the path it is given), so a batch that is run again uses the same."""

    def lookups(note: str) -> Lookups:
        noted = writers.read_if_there(spark, note)
        if noted is None:
            version, _ = writers.newest_version(spark, catalogue)
            spark.createDataFrame([(version,)], "version bigint").write.mode("overwrite").parquet(note)
        else:
            version = noted.first()["version"]
        return readers.read_templates(spark, writers.version_path(catalogue, version)), readers.read_key_aliases(spark, aliases), readers.read_channels(spark, channels)

    return lookups


def stream_dispatch(lines: DataFrame, lookups: Lookups | Callable[[str], Lookups], path: str, checkpoint: str) -> StreamingQuery:
    """Start dispatching what is there and stop: ``path``/outbox and ``path``/rejects. A batch that is run again
    overwrites its own part of both.

    ``lines``: a stream of ``readers.request_lines``; ``lookups``: fixed tables, or what gives them for each micro-batch."""

    def put(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        judged = checked(readers.parse_requests(readers.numbered_lines(held)))
        tables = lookups(f"{path}/lookups/batch_id={batch_id}") if callable(lookups) else lookups
        try:
            writers.write_outbox(batches.outbox_wide(outbox(resolved(judged, tables))), f"{path}/outbox", batch_id)
            writers.write_outbox(rejects(judged), f"{path}/rejects", batch_id)
        finally:
            held.unpersist()

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
