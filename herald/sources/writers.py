"""Sinks: the ledger, the catalogue's snapshots and the outbox. All of them are parquet."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of the outbox for a date.
BUCKETS = 16


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at a path, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _put(rows: DataFrame, path: str) -> None:
    """One table's part of a commit."""
    rows.write.mode("append").partitionBy("sent_date", "commit").parquet(path)


def write_send_ledger(rows: DataFrame, path: str, recipients: DataFrame | None = None, key: str = "request_id") -> str:
    """Append finished requests, and their recipients as a child table, under one commit. -> the commit's name, a new one each time.

    Both tables (``path``/ledger, ``path``/recipients) are partitioned by ``sent_date`` and commit; the commit counts from
    the moment its name is in ``path``/manifest, which is written last, and ``read_ledger`` and ``read_recipients`` follow
    the manifest: a job that dies leaves neither half. Rows whose key the ledger has on the same dates are left out, with
    their recipients, so a replay adds nothing; only those dates are read, and the rows are evaluated once.
    """
    spark = rows.sparkSession
    commit = f"c{uuid.uuid4().hex}"
    held = rows.dropDuplicates([key]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        new, old = held, read_ledger(spark, path)
        if old is not None:
            new = held.join(old.join(held.select("sent_date").distinct(), "sent_date", "left_semi").select(key), key, "left_anti")
        _put(new.withColumn("commit", F.lit(commit)), f"{path}/ledger")
        if recipients is not None:
            mine = spark.read.schema(held.select(key, "sent_date").schema.add("commit", "string")).parquet(f"{path}/ledger").where(F.col("commit") == commit)
            _put(recipients.join(mine, key), f"{path}/recipients")
        spark.createDataFrame([(commit,)], "commit string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    finally:
        held.unpersist()
    return commit


def _committed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    rows, manifest = read_if_there(spark, f"{path}/{name}"), read_if_there(spark, f"{path}/manifest")
    if rows is None or manifest is None:
        return None
    return rows.join(manifest.select("commit").distinct(), "commit", "left_semi").drop("commit")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger's committed rows, or None where there is none yet."""
    return _committed(spark, path, "ledger")


def read_recipients(spark: SparkSession, path: str) -> DataFrame | None:
    """The recipients of the committed rows."""
    return _committed(spark, path, "recipients")


def version_path(root: str, version: int) -> str:
    return f"{root}/versions/{version:010d}"


def write_template_snapshot(merged: DataFrame, root: str, version: int) -> str:
    """The catalogue after a merge, as a new version; the pointer table moves on only when it is whole."""
    path = version_path(root, version)
    merged.where("action <> 'delete'").drop("action").write.mode("overwrite").parquet(path)
    merged.sparkSession.createDataFrame([(version, path)], "version bigint, path string").write.mode("append").parquet(f"{root}/pointer")
    return path


def newest_version(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and path of the newest snapshot."""
    pointer = read_if_there(spark, f"{root}/pointer")
    return None if pointer is None else tuple(pointer.agg(F.max(F.struct("version", "path")).alias("x")).select("x.*").first())


def newest_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    found = newest_version(spark, root)
    return None if found is None else spark.read.parquet(found[1])


def bucket_of(request_id: Column) -> Column:
    return F.pmod(F.xxhash64(request_id), F.lit(BUCKETS)).cast("int")


def write_outbox(params: DataFrame, path: str, batch_id: int | None = None, run_date: str | None = None) -> None:
    """One row per (request_id, batch_index) with its ordered parameters; a stream's batch overwrites its own folder.

    A batch job names its date. Its rows go to partitions of that date and of a bucket of the request; rows whose key
    stands there already are not written again, so a replay adds nothing, and it reads the keys of that date and those
    buckets alone, however large the outbox is. (Overwriting the partitions instead would lose other runs of the day.)"""
    if batch_id is not None:
        params.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        return
    if run_date is None:
        raise ValueError("write_outbox takes a stream's batch_id or a job's run_date")
    rows = params.withColumns({"run_date": F.lit(run_date).cast("date"), "bucket": bucket_of(F.col("request_id"))})
    unsent(rows, read_if_there(params.sparkSession, path), run_date).write.mode("append").partitionBy("run_date", "bucket").parquet(path)


def unsent(rows: DataFrame, outbox: DataFrame | None, run_date: str) -> DataFrame:
    """Rows whose key the outbox does not have on that date."""
    if outbox is None:
        return rows
    there = outbox.where(F.col("run_date") == F.lit(run_date).cast("date")).select("bucket", "request_id", "batch_index")
    return rows.join(there, ["bucket", "request_id", "batch_index"], "left_anti").select(rows.columns)
