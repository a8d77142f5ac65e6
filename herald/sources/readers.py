"""Sources: JSON, parquet and text, each with a declared schema, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herald.operators.access_log import parse_access_log
from herald.operators.catalog import BUTTON, explode_templates, map_provider_template, unwrap_success_envelope
from herald.sources.writers import read_ledger, read_recipients  # noqa: F401  the ledger's readers

RECIPIENT = f"struct<phoneNumber:string,name:string,variables:string,content:string,buttons:array<{BUTTON}>,emtitle:string,failoverSubject:string,failoverMessage:string>"
REQUEST = f"unionId string, senderId string, templateCode string, noticeId string, requestKey string, first bigint, recipients array<{RECIPIENT}>, _corrupt_record string"
ENVELOPE = "page bigint, code int, message string, list array<string>"
RESPONSE = "request_id bigint, batch_index bigint, code int, message string, info struct<type:string,mid:string,current:string,unit:decimal(18,2),total:decimal(18,2),scnt:bigint,fcnt:bigint>"
SENT = "request_id bigint, batch_index bigint, batch_size bigint, n_batches bigint, sent_ts timestamp"
#: Splits whose line counts may be broadcast (some 150 bytes each).
BROADCAST_SPLITS = 1_000_000
JOB_EVENT = "job_id bigint, event_id bigint, event_ts timestamp, status string, error string"


def _source(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def request_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The lines of request files as they are split for reading: ingest_file, ingest_block (where the split begins), value."""
    return _source(spark, stream).text(path).select(F.col("_metadata.file_path").alias("ingest_file"), F.col("_metadata.file_block_start").alias("ingest_block"), "value")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Adds ``ingest_line``, a line's number in its file from 0, whatever the splits: the lines of each split are counted
    (the first of two passes; one row a split), the counts of a file's splits are summed, and a line has its place in its
    split besides. No line is shuffled. On a stream, for the rows of one micro-batch."""
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    splits = placed.groupBy("ingest_file", "ingest_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy("ingest_file").orderBy("ingest_block").rowsBetween(W.unboundedPreceding, -1)
    before = splits.select("ingest_file", "ingest_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    few = len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= BROADCAST_SPLITS
    return placed.join(F.broadcast(before) if few else before, ["ingest_file", "ingest_block"]).withColumn("ingest_line", (F.col("_base") + F.col("_at") - F.col("_first")).cast("bigint")).drop("_at", "_first", "_base")


def parse_requests(lines: DataFrame) -> DataFrame:
    """Numbered lines as requests; a line that does not parse has ``corrupt_record``, and blank lines are none.

    A request of many recipients may come in parts, each a line of the same file with the request's fields, its
    ``requestKey`` (one in the file) and ``first``, the position of the part's first recipient: a line is held whole, so
    it is the line that has to be small, not the request. A recipient's ``variables`` stay JSON text, as a map would lose
    the order and the repeats of their keys."""
    parsed = F.from_json("value", REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.where(F.trim("value") != "").select("ingest_file", "ingest_line", parsed.alias("r")).select("ingest_file", "ingest_line", "r.*")
    return rows.select(
        F.col("unionId").alias("union_id"), F.col("senderId").alias("sender_id"), F.col("templateCode").alias("template_code"), F.col("noticeId").alias("notice_id"), "recipients",
        F.col("requestKey").alias("request_key"), F.coalesce("first", F.lit(0).cast("bigint")).alias("first_seq"),
        F.col("_corrupt_record").alias("corrupt_record"), "ingest_file", "ingest_line",
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Send requests, one JSON object a line, with file and line, which are the same for splits of any size.

    A stream takes ``request_lines`` instead and numbers and parses each micro-batch."""
    return parse_requests(numbered_lines(request_lines(spark, path)))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "kakao_channel_id")


def read_key_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Names and aliases alone: a secret's value is never read."""
    return spark.read.parquet(path).select("name", "key_alias")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("message_type", F.col("unit_price").cast("decimal(18,2)").alias("unit_price"))


def read_provider_templates(spark: SparkSession, path: str) -> DataFrame:
    """The provider's listing: successful envelopes, one JSON object a line, flattened and renamed, with page, position in
    the list, and the names of the fields that each template has, null or not."""
    return map_provider_template(explode_templates(unwrap_success_envelope(spark.read.schema(ENVELOPE).json(path))))


def read_provider_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE).json(path)


def _file_stream(spark: SparkSession, schema: str, path: str, files: int | None) -> DataFrame:
    source = spark.readStream.schema(schema)
    return (source.option("maxFilesPerTrigger", files) if files else source).json(path)


def read_sent_batches(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Sent batches as a stream of JSON files, at most ``files`` of them in a micro-batch."""
    return _file_stream(spark, SENT, path, files)


def read_answers(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The provider's answers as a stream of JSON files, with the time of the answer."""
    return _file_stream(spark, f"{RESPONSE}, answered_ts timestamp", path, files)


def read_job_events(spark: SparkSession, path: str, stream: bool = False, files: int | None = None) -> DataFrame:
    """Job transitions; of a stream at most ``files`` files in a micro-batch."""
    return _file_stream(spark, JOB_EVENT, path, files) if stream else spark.read.schema(JOB_EVENT).json(path)


def access_lines(spark: SparkSession, path: str, stream: bool = False, files: int | None = None) -> DataFrame:
    """Lines of the access log (``value``), at most ``files`` files of them in a micro-batch."""
    source = _source(spark, stream)
    return (source.option("maxFilesPerTrigger", files) if files else source).text(path)


def read_access_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The calls that ended, as columns; ``operators.access_log.access_log_rejects`` of ``access_lines`` has what is no access line."""
    return parse_access_log(access_lines(spark, path, stream))
