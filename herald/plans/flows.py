"""Registered queries that pass through files: each source reads what was written from the given tables, each sink is
read back, and the streams run to the end of their input."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herald.operators import batches, requests
from herald.plans import jobs as plans
from herald.plans.registry import _BUTTON, _LEDGER, _LISTED, _OUTBOX, _PLAIN, _RESOLVED, _SHOWN, _STATE, _STATES, _SYNCED, _TRISTATE, AS_OF, _envelopes, _lines, _planned, _query, _responses, _settled, _shown_lines, shown_catalog, shown_ledger, synced
from herald.sources import readers, writers
from herald.sources.fixtures import frame, with_sql
from herald.streaming import access_log, dispatch, job_state, ledger, settlement

#: Seconds that a stream over the given tables may take.
WAIT = 3600
#: Event-time watermark delays: one that no event of the tables is behind, and none.
EVER, AT_ONCE = "36500 days", "0 seconds"


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")



def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the session's process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/flow-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """A setting of the caller's session, for as long as it is needed."""
    held = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def _as_json(rows: DataFrame, path: str, mode: str = "overwrite") -> str:
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    rows.select(F.to_json(F.struct("*"), {"timestampNTZFormat": exact}).alias("value")).write.mode(mode).text(path)
    return path


def _ended(query) -> None:
    if not query.awaitTermination(WAIT):
        query.stop()
        raise TimeoutError(f"the stream has not ended after {WAIT} seconds")


def _request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its recipients nested, one JSON object a line, in parts of a batch's size where it has more; and
    a line that does not parse for each region. Parts of a request stand in one file."""
    person = F.struct(F.col("phone_number").alias("phoneNumber"), "name", F.create_map(F.lit("name"), "name", F.lit("order"), "var_order", F.lit("amount"), "var_amount").alias("variables"), "content", F.col("failover_subject").alias("failoverSubject"), F.col("failover_message").alias("failoverMessage"))
    recipients = frame(spark, sf_dir, "recipients")
    part = F.floor(F.col("seq") / batches.BATCH).alias("part")
    people = recipients.groupBy("request_id", part).agg(F.array_sort(F.collect_list(F.struct("seq", F.to_json(person).alias("person")))).alias("people"))
    head = F.to_json(F.struct(F.col("union_id").alias("unionId"), F.col("sender_id").alias("senderId"), F.col("template_code").alias("templateCode"), F.col("notice_id").alias("noticeId"),
        F.when(F.col("recipient_count") > batches.BATCH, F.col("request_id").cast("string")).alias("requestKey"), F.get("people", F.lit(0))["seq"].alias("first")))
    nested = F.array_join(F.transform(F.coalesce("people", F.array()), lambda p: p["person"]), ",")
    counted = frame(spark, sf_dir, "requests").join(requests.recipient_count(recipients), "request_id", "left")
    whole = counted.join(people, "request_id", "left").select("request_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"recipients":['), nested, F.lit("]}")).alias("value"))
    return whole.repartition("request_id").select("value").union(frame(spark, sf_dir, "region").select(F.concat(F.lit("{broken "), "r_name")))


def _dispatched(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    _request_lines(spark, sf_dir).write.text(f"{path}/in")
    for name in ("key_aliases", "channels"):
        frame(spark, sf_dir, name).write.parquet(f"{path}/{name}")
    writers.write_template_snapshot(frame(spark, sf_dir, "template_target").withColumn("action", F.lit("keep")), f"{path}/catalogue", 1)
    lookups = dispatch.newest_lookups(spark, f"{path}/catalogue", f"{path}/key_aliases", f"{path}/channels")
    _ended(dispatch.stream_dispatch(readers.request_lines(spark, f"{path}/in", stream=True), lookups, f"{path}/out", f"{path}/state"))
    return f"{path}/out"


@_query(_RESOLVED.replace("resolved as (", "numbered as (select union_id, template_code, recipient_count, row_number() over (order by request_id) - 1 as line from (select r.*, coalesce(c.recipient_count, 0) as recipient_count from requests r left join counts c using (request_id))), resolved as (")
        + " select cast(line as bigint) as ingest_line, union_id, template_code, cast(recipient_count as int) as recipient_count from numbered")
def read_request_lines(spark, sf_dir):
    """Requests of one file of JSON lines, read in splits of 64 KB: each has its line's number."""
    path = scratch(spark)
    heads = frame(spark, sf_dir, "requests").select("request_id", F.to_json(F.struct(F.col("union_id").alias("unionId"), F.col("template_code").alias("templateCode"))).alias("head"))
    people = frame(spark, sf_dir, "recipients").groupBy("request_id").agg(F.count("*").cast("int").alias("n"))
    nested = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat(F.lit('{"phoneNumber":"'), k.cast("string"), F.lit('"}'))), ",")
    lines = heads.join(people, "request_id", "left").select("request_id", F.concat(F.regexp_replace("head", r"\}$", ""), F.lit(',"recipients":['), F.when(F.col("n") > 0, nested).otherwise(""), F.lit("]}")).alias("value"))
    lines.repartitionByRange(1, "request_id").sortWithinPartitions("request_id").select("value").write.text(f"{path}/in")
    with _set(spark, "spark.sql.files.maxPartitionBytes", "64k"):
        rows = readers.read_requests(spark, f"{path}/in").select("ingest_line", "union_id", "template_code", F.coalesce(F.size("recipients"), F.lit(0)).alias("recipient_count"))
        rows.write.parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows")


@_query(_OUTBOX.format(""))
def t1_stream_dispatch(spark, sf_dir):
    """Nested requests as a stream of files, to the outbox. Request ids are hashes of file and line, so they are left out."""
    wide = spark.read.parquet(_dispatched(spark, sf_dir) + "/outbox")
    return wide.select("batch_index", F.inline("params")).select("batch_index", "slot", "param", "value")


_NULL_PHONES = "select r.request_id, seq from recipients r join accepted a on r.request_id = a.request_id where phone_number is null"


@_query(f"""{_RESOLVED} select cast(null as bigint) as seq, 'CORRUPT' as reject_code from region union all
select null, 'INVALID_PARAMS' from requests where request_id not in (select request_id from accepted) union all select seq, 'NO_PHONE' from ({_NULL_PHONES})""")
def t1_stream_rejects(spark, sf_dir):
    """What the dispatch leaves out: lines that do not parse, requests that are not valid, recipients without a number."""
    return spark.read.parquet(_dispatched(spark, sf_dir) + "/rejects").select("seq", "reject_code")


def _job_stream(spark: SparkSession, path: str, late: str) -> None:
    """All files that are there, as one micro-batch; states go to ``path``/states."""
    states = job_state.stream_job_state(readers.read_job_events(spark, f"{path}/in", stream=True), late)
    put = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/states/n={n}")
    with _set(spark, "spark.sql.streaming.stateStore.providerClass", job_state.PROVIDER):
        _ended(states.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())


@_query(_STATE + " select * from state")
def t2_stream_job_state(spark, sf_dir):
    """Job events as a stream of JSON files: the last state of each job is that of the batch fold."""
    path = scratch(spark)
    _as_json(frame(spark, sf_dir, "job_events"), f"{path}/in")
    _job_stream(spark, path, EVER)
    shown = ("job_id", "status", "created_at", "started_at", "completed_at", "error")
    last = spark.read.parquet(f"{path}/states").groupBy("job_id").agg(F.max_by(F.struct(*shown[1:]), "batch").alias("s")).select("job_id", "s.*")
    return last.withColumns({c: F.col(c).cast("timestamp_ntz") for c in shown[2:5]})


def _timed_out(spark: SparkSession, sf_dir: str) -> str:
    """The events up to AS_OF, then nothing but the time, which moves on to AS_OF."""
    path = scratch(spark)
    _as_json(frame(spark, sf_dir, "job_events").where(F.col("event_ts") <= _as_of()), f"{path}/in")
    _job_stream(spark, path, AT_ONCE)
    for tick in (-3, -2, -1):  # an event at the watermark itself would be late
        _as_json(spark.range(1).select(F.lit(tick).cast("bigint").alias("job_id"), F.lit(tick).cast("bigint").alias("event_id"), (_as_of() + F.expr(f"make_dt_interval(0, 0, 0, {tick + 1} / 1000)")).alias("event_ts"), F.lit("pending").alias("status")), f"{path}/in", "append")
        _job_stream(spark, path, AT_ONCE)
    return path


_UNTIL = _STATE.replace("from job_events group by 1", f"from job_events where event_ts <= timestamp '{AS_OF}' group by 1").replace("min(event_ts) as created_at", "min(event_ts) as created_at, max(event_ts) as last_at")


@_query(_UNTIL + f" select job_id, 'failed' as status, started_at + interval 5 minutes as completed_at, coalesce(error, 'TIME_OUT') as error from state where completed_at is null and started_at + interval 5 minutes <= timestamp '{AS_OF}'")
def t3_stream_time_out(spark, sf_dir):
    """Jobs that the stream's timers fail, as time has moved on to AS_OF."""
    out = spark.read.parquet(_timed_out(spark, sf_dir) + "/states").where("timed_out")
    return out.select("job_id", "status", F.col("completed_at").cast("timestamp_ntz").alias("completed_at"), "error")


@_query(_UNTIL + f""" select job_id from state where case when completed_at is not null then completed_at + interval 1 hour when started_at is not null then started_at + interval 65 minutes else last_at + interval 24 hours end > timestamp '{AS_OF}'
union all select unnest([-1, -2, -3])""")
def t4_state_retention(spark, sf_dir):
    """The jobs whose state the stream still holds at AS_OF, read from the state store."""
    held = spark.read.format("statestore").option("stateVarName", "job").load(_timed_out(spark, sf_dir) + "/state")
    return held.select(F.col("key.job_id").alias("job_id"))


_LEDGER_SHOWN = _LEDGER + " select request_id, union_id, template_code, sender_id, notice_id, recipient_count, success_count, fail_count, success, coalesce(batch_results, '') as batch_results, cast(sent_at as date) as sent_date from ledger"
_LEDGER_COLUMNS = ("request_id", "union_id", "template_code", "sender_id", "notice_id", "recipient_count", "success_count", "fail_count", "success", "batch_results", "sent_date")


@_query(_LEDGER_SHOWN)
def t5_stream_ledger(spark, sf_dir):
    """Ledger rows as a stream, run twice with separate checkpoints: the second run adds nothing."""
    path = scratch(spark)
    _settled(spark, sf_dir, priced=True)["ledger"].write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    for run in ("a", "b"):
        _ended(ledger.stream_ledger(stream, f"{path}/ledger", f"{path}/{run}"))
    return shown_ledger(readers.read_ledger(spark, f"{path}/ledger")).select(*_LEDGER_COLUMNS)


def _settlement_inputs(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Sent batches and answers as JSON, in files that arrive one after the other: an answer up to four minutes after its
    batch, those of odd batches a file later. At last time moves on, so that batches without an answer fail. -> requests."""
    resolved = plans.resolved_requests(frame(spark, sf_dir, "requests"), requests.recipient_count(frame(spark, sf_dir, "recipients")), *[frame(spark, sf_dir, n) for n in ("template_target", "key_aliases", "channels")])
    found = resolved.where("template_found").select("request_id")
    many = frame(spark, sf_dir, "batches").groupBy("request_id").agg(F.count("*").alias("n_batches"))
    begun = lambda seconds: (_as_of() + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("sent_ts")
    sent = frame(spark, sf_dir, "batches").join(found, "request_id").join(many, "request_id").select("request_id", "batch_index", "batch_size", "n_batches", begun(F.col("request_id") * 60 + F.col("batch_index")))
    none = resolved.join(sent, "request_id", "left_anti").select("request_id", F.lit(-1).cast("bigint").alias("batch_index"), F.lit(0).cast("bigint").alias("batch_size"), F.lit(0).cast("bigint").alias("n_batches"), begun(F.col("request_id") * 60))
    answers = _responses(spark, sf_dir).join(sent.select("request_id", "batch_index", "sent_ts"), ["request_id", "batch_index"])
    timed = answers.withColumn("answered_ts", F.col("sent_ts") + F.make_dt_interval(mins=F.pmod("batch_index", F.lit(5)).cast("int"))).drop("sent_ts")
    tick = lambda day: (_as_of() + F.make_dt_interval(days=F.lit(day)))
    no_batch = lambda day: spark.range(1).select(F.lit(-day).cast("bigint").alias("request_id"), F.lit(0).cast("bigint").alias("batch_index"), F.lit(0).cast("bigint").alias("batch_size"), F.lit(1).cast("bigint").alias("n_batches"), tick(day).alias("sent_ts"))
    no_answer = lambda day: spark.range(1).select(F.lit(-day).cast("bigint").alias("request_id"), F.lit(-1).cast("bigint").alias("batch_index"), tick(day).alias("answered_ts"))
    for part in (sent.union(none), no_batch(1), no_batch(2), no_batch(3)):
        _as_json(part.coalesce(1), f"{path}/sent", "append")
    for part in (timed.where("batch_index % 2 = 0"), timed.where("batch_index % 2 = 1"), no_answer(2), no_answer(3)):
        _as_json(part.coalesce(1), f"{path}/answers", "append")
    resolved.write.parquet(f"{path}/resolved")
    return spark.read.parquet(f"{path}/resolved")


@_query(_LEDGER_SHOWN)
def t5_stream_settlement(spark, sf_dir):
    """Batches and answers as two streams that meet by event time, one file of each in a micro-batch: the ledger is that of settle_campaign."""
    path = scratch(spark)
    resolved = _settlement_inputs(spark, sf_dir, path)
    frame(spark, sf_dir, "prices").write.parquet(f"{path}/prices")
    prices = readers.read_prices(spark, f"{path}/prices")
    for _ in range(2):  # the second run has nothing new
        with _set(spark, "spark.sql.streaming.stateStore.providerClass", job_state.PROVIDER):
            _ended(settlement.stream_settlement(readers.read_sent_batches(spark, f"{path}/sent", 1), readers.read_answers(spark, f"{path}/answers", 1), resolved, _as_of(), f"{path}/ledger", f"{path}/state", prices, wait="5 minutes"))
    return shown_ledger(readers.read_ledger(spark, f"{path}/ledger")).select(*_LEDGER_COLUMNS)


@_query(_LEDGER_SHOWN)
def settle_and_write_ledger(spark, sf_dir):
    """settle_campaign, its answers read from JSON, to write_send_ledger; written twice."""
    path = scratch(spark)
    answers = readers.read_provider_responses(spark, _as_json(_responses(spark, sf_dir), f"{path}/answers"))
    resolved = plans.resolved_requests(frame(spark, sf_dir, "requests"), frame(spark, sf_dir, "recipients").groupBy("request_id").agg(F.count("*").alias("recipient_count")), *[frame(spark, sf_dir, n) for n in ("template_target", "key_aliases", "channels")])
    rows = plans.settle_campaign(resolved, frame(spark, sf_dir, "batches"), answers, _as_of(), frame(spark, sf_dir, "prices"))["ledger"]
    for _ in range(2):
        writers.write_send_ledger(rows, f"{path}/ledger", frame(spark, sf_dir, "recipients"))
    return shown_ledger(readers.read_ledger(spark, f"{path}/ledger")).select(*_LEDGER_COLUMNS)


@_query(_LEDGER + f" select r.request_id, seq, phone_number, name, date '{AS_OF[:10]}' as sent_date from recipients r join ledger l on r.request_id = l.request_id")
def ledger_recipients(spark, sf_dir):
    """The recipients of the ledger's requests, as the child table that one commit writes with it; written twice, after a
    commit that died between the two tables and so does not count."""
    path = scratch(spark)
    rows, people = _settled(spark, sf_dir, priced=True)["ledger"], frame(spark, sf_dir, "recipients").select("request_id", "seq", "phone_number", "name")
    half = rows.withColumn("commit", F.lit("died"))
    writers._put(half, f"{path}/ledger")
    for _ in range(2):
        writers.write_send_ledger(rows, path, people)
    return readers.read_recipients(spark, path).select("request_id", "seq", "phone_number", "name", "sent_date")


@_query(_OUTBOX.format("request_id, "))
def plan_and_write_outbox(spark, sf_dir):
    """plan_campaign to write_outbox, written twice."""
    path = scratch(spark)
    wide = batches.outbox_wide(_planned(spark, sf_dir)["outbox"])
    for _ in range(2):
        writers.write_outbox(wide, f"{path}/outbox", run_date=AS_OF[:10])
    return spark.read.parquet(f"{path}/outbox").select("request_id", "batch_index", F.inline("params")).select("request_id", "batch_index", "slot", "param", "value")


@_query(with_sql("channels", "key_aliases", "prices") + """ select 'channel' as kind, id as name, kakao_channel_id as value from channels union all select 'alias', name, key_alias from key_aliases
union all select 'price', message_type, cast(unit_price as string) from prices""")
def read_lookups(spark, sf_dir):
    """Channels, key aliases and prices, written and read back; a column that is a secret stays unread."""
    path = scratch(spark)
    for name in ("channels", "key_aliases", "prices"):
        frame(spark, sf_dir, name).withColumn("secret", F.lit("never read")).write.parquet(f"{path}/{name}")
    shown = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("string").alias("value"))
    channels = shown(readers.read_channels(spark, f"{path}/channels"), "channel", "id", "kakao_channel_id")
    aliases = shown(readers.read_key_aliases(spark, f"{path}/key_aliases"), "alias", "name", "key_alias")
    return channels.union(aliases).union(shown(readers.read_prices(spark, f"{path}/prices"), "price", "message_type", "unit_price"))


@_query(_LISTED + f" select page, place as pos, template_code, {_SHOWN}, cdate, {_BUTTON}, concat_ws(',', {', '.join(f"case when not ({_STATES[c].replace('s.', '')}) then '{c}' end" for c in sorted(_STATES))}) as present from listed")
def read_provider_templates(spark, sf_dir):
    """The provider's listing from JSON envelopes: those that failed are left out; dates as they are, and which of the fields are there that may be absent."""
    rows = readers.read_provider_templates(spark, _as_json(_envelopes(spark, sf_dir), f"{scratch(spark)}/listing"))
    present = F.array_join(F.array_sort(F.array_intersect("present", F.array(*map(F.lit, _STATES)))), ",")
    return rows.select("page", "pos", "template_code", "template_content", *_PLAIN, *_TRISTATE, "cdate", F.get("buttons", F.lit(0))["name"].alias("button"), present.alias("present"))


@_query(_SYNCED + " select * exclude (action) from synced where action <> 'delete'")
def sync_and_write_snapshot(spark, sf_dir):
    """The listing from JSON, without malformed dates, merged into the stored catalogue and written as its newest snapshot, all fields."""
    path = scratch(spark)
    writers.write_template_snapshot(frame(spark, sf_dir, "stored_templates").withColumn("action", F.lit("keep")), f"{path}/catalogue", 1)
    listed = readers.read_provider_templates(spark, _as_json(_envelopes(spark, sf_dir), f"{path}/listing"))
    merged = synced(spark, sf_dir, listed, readers.read_templates(spark, f"{path}/catalogue/versions/{1:010d}"))["merged"]
    writers.write_template_snapshot(merged, f"{path}/catalogue", 2)
    return shown_catalog(writers.newest_snapshot(spark, f"{path}/catalogue"))


@_query(with_sql("access_log") + " select date_trunc('second', ts) as ts, case when status >= 400 then 'ERROR' else 'INFO' end as level, method, path, status, duration_ms from access_log")
def read_access_log(spark, sf_dir):
    """Log lines, written as text and read back as columns."""
    path = scratch(spark)
    _lines(spark, sf_dir).write.text(f"{path}/in")
    return readers.read_access_log(spark, f"{path}/in").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _lines_in_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Access lines in the order of time in three files; at the last one lines that begin a call, others, and a much later time."""
    third = F.ntile(3).over(W.orderBy("ts", "event_id"))
    rows = frame(spark, sf_dir, "access_log").withColumn("part", third)
    for k in (1, 2, 3):
        _shown_lines(rows.where(F.col("part") == k)).coalesce(1).write.mode("append").text(path)
    others = frame(spark, sf_dir, "region").select(F.explode(F.array(F.concat(F.lit("[2024-01-01 00:00:00] GET /"), F.col("r_regionkey").cast("string")), F.concat(F.lit("broken "), "r_name"), F.lit(" "))).alias("value"))
    for day in (1, 2, 3):
        later = spark.range(1).select(F.concat(F.lit("["), F.date_format(F.lit("2100-01-01").cast("timestamp") + F.make_dt_interval(days=F.lit(day)), "yyyy-MM-dd HH:mm:ss"), F.lit("] [INFO] GET /later - 200 (1ms)")).alias("value"))
        (later.union(others) if day == 1 else later).coalesce(1).write.mode("append").text(path)


def _access_stream(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    _lines_in_files(spark, sf_dir, f"{path}/in")
    for query in access_log.stream_access_log(readers.access_lines(spark, f"{path}/in", stream=True, files=1), path, f"{path}/state"):
        _ended(query)
    return path


@_query(with_sql("access_log") + " select date_trunc('hour', ts) as window_start, method, path, count(*) as calls, count(*) filter (where status >= 400) as errors, cast(sum(duration_ms) as bigint) as duration_ms from access_log group by 1, 2, 3")
def l1_stream_levels(spark, sf_dir):
    """The access log as a stream: hourly counts, each window once it has ended."""
    rows = spark.read.parquet(_access_stream(spark, sf_dir) + "/levels").where("path <> '/later'")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("select 'broken ' || r_name as value, 'NO_ACCESS_LINE' as reject_code from region")
def l1_stream_rejects(spark, sf_dir):
    """Lines that begin or end no call."""
    return spark.read.parquet(_access_stream(spark, sf_dir) + "/rejects")


_FILES, _LATE = 4, "10 days"


@_query(with_sql("job_events") + f""", e as (select *, (event_id * 7 + job_id) % {_FILES} as k from job_events),
m as (select k, max(max(event_ts)) over (order by k rows between unbounded preceding and 1 preceding) - interval {_LATE} as mark from e group by k)
select event_id, job_id, event_ts, status, error, case when event_ts <= mark then 'LATE' end as reject_code from e join m on e.k = m.k""")
def t2_stream_late_events(spark, sf_dir):
    """Job events whose files arrive out of the order of time, split by the watermark: late ones are kept, with a code."""
    path = scratch(spark)
    events = frame(spark, sf_dir, "job_events")
    for k in range(_FILES):
        _as_json(events.where((F.col("event_id") * 7 + F.col("job_id")) % _FILES == k).coalesce(1), f"{path}/in", "append")
    _ended(job_state.gate(readers.read_job_events(spark, f"{path}/in", stream=True, files=1), path, f"{path}/state", _LATE))
    both = spark.read.parquet(f"{path}/accepted").unionByName(spark.read.parquet(f"{path}/late"), allowMissingColumns=True)
    return both.select("event_id", "job_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "status", "error", "reject_code")


@_query(_STATE + f""" select job_id, status, started_at, completed_at, coalesce(coalesce(completed_at, timestamp '{AS_OF}') > started_at + interval 5 minutes, false) as timed_out from state
where completed_at is null or completed_at >= timestamp '{AS_OF}' - interval 1 hour""")
def job_report_state(spark, sf_dir):
    """job_report over job events read from JSON: folded, time-outs marked, old ones gone."""
    events = readers.read_job_events(spark, _as_json(frame(spark, sf_dir, "job_events"), f"{scratch(spark)}/in"))
    state = plans.job_report(events.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz")), _as_of())["state"]
    return state.select("job_id", "status", "started_at", "completed_at", "timed_out")
