"""Streams over split files give the batch answers, and replays add nothing."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from herald.operators import jobs
from herald.sources import readers, writers
from herald.sources.fixtures import frame
from herald.streaming import access_log, dispatch, job_state, ledger, settlement

WAIT = 120


def test_job_state_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = []
    for job in range(30):
        for k, (status, error) in enumerate([("pending", None), ("processing", None), ("failed", f"E{job}") if job % 3 == 0 else ("completed", None)]):
            rows.append({"job_id": job, "event_id": 3 * job + k, "event_ts": (t + datetime.timedelta(seconds=job + k)).isoformat(), "status": status, "error": error})
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / f"in/{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part::3]))
    stream = spark.readStream.schema(readers.JOB_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = job_state.stream_job_state(stream)
    seen: dict = {}

    def keep(batch, _):
        seen.update({r["job_id"]: (r["status"], r["error"]) for r in batch.collect()})

    query = out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(WAIT)
    batch = jobs.fold_job_state(readers.read_job_events(spark, str(tmp_path / "in")))
    assert seen == {r["job_id"]: (r["status"], r["error"]) for r in batch.collect()}


def test_time_out_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = lambda m: (t + datetime.timedelta(minutes=m)).isoformat()
    (tmp_path / "in").mkdir()
    files = [[(1, 1, at(0), "processing")], [(2, 2, at(60), "pending")], [(3, 3, at(61), "pending")]]
    files.append([(4, 4, at(2), "pending"), (5, 5, at(62), "pending")])  # the first of them comes too late
    files.append([(6, 6, at(200), "pending")])
    for k, rows in enumerate(files):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("job_id", "event_id", "event_ts", "status"), r))) for r in rows))
        os.utime(tmp_path / f"in/{k}.json", (1.7e9 + 10 * k,) * 2)  # the source reads files by the time of their change
    stream = spark.readStream.schema(readers.JOB_EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    got, told = [], job_state.LateEvents()
    spark.streams.addListener(told)
    query = job_state.stream_job_state(stream, "1 minute").writeStream.foreachBatch(lambda b, _: got.extend((r["job_id"], r["timed_out"]) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(WAIT)
    assert (1, False) in got and (1, True) in got and (2, True) not in got
    assert 4 not in {j for j, _ in got} and told.of(query) == 1
    spark.streams.removeListener(told)


def test_state_ends(spark, tmp_path):
    """A failed job's state goes after its retention, that of a job that never starts after a day."""
    t = datetime.datetime(2024, 1, 1)
    at = lambda m: (t + datetime.timedelta(minutes=m)).isoformat()
    (tmp_path / "in").mkdir()
    files = [[(1, 1, at(0), "processing"), (2, 2, at(0), "pending")], *[[(k, k, at(m), "pending")] for k, m in ((3, 10), (4, 200), (5, 2000), (6, 2001))]]
    for k, rows in enumerate(files):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("job_id", "event_id", "event_ts", "status"), r))) for r in rows))
        os.utime(tmp_path / f"in/{k}.json", (1.7e9 + 10 * k,) * 2)
    stream = spark.readStream.schema(readers.JOB_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = job_state.stream_job_state(stream, "0 seconds").writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(WAIT)
    held = spark.read.format("statestore").option("stateVarName", "job").load(str(tmp_path / "c"))
    assert {r["key"]["job_id"] for r in held.collect()} == {5, 6}


def test_dispatch_stream(spark, tmp_path, sf_dir):
    templates, aliases, channels = (frame(spark, sf_dir, n) for n in ("template_target", "key_aliases", "channels"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        people = [{"phoneNumber": f"010-1234-{i:04d}" if i != 7 else None, "name": f"n{i}", "variables": {"name": f"n{i}", "order": str(i)}} for i in range(503)]
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"unionId": str(k), "templateCode": f"Brand#{k + 1}", "recipients": people}) + "\n" + json.dumps({"unionId": "", "templateCode": "x", "recipients": []}) + "\n{broken\n")
    stream = readers.request_lines(spark, str(tmp_path / "in"), stream=True)
    query = dispatch.stream_dispatch(stream, (templates, aliases, channels), str(tmp_path / "out"), str(tmp_path / "c"))
    assert query.awaitTermination(WAIT)
    once = spark.read.parquet(str(tmp_path / "out/outbox"))
    left = spark.read.parquet(str(tmp_path / "out/rejects")).groupBy("reject_code").count().collect()
    assert {r["reject_code"]: r["count"] for r in left} == {"CORRUPT": 3, "INVALID_PARAMS": 3, "NO_PHONE": 3}
    rows = sorted((r["request_id"], r["batch_index"], len(r["params"])) for r in once.collect())
    assert len(rows) == 6
    batch = dispatch.outbox(dispatch.resolved(dispatch.checked(readers.read_requests(spark, str(tmp_path / "in"))), (templates, aliases, channels)))
    want = batch.groupBy("request_id", "batch_index").count().collect()
    assert rows == sorted((r["request_id"], r["batch_index"], r["count"]) for r in want)
    slots = {int(r["slot"]) for r in batch.where("batch_index = 0 and slot > 0").select("slot").distinct().collect()}
    assert slots == set(range(1, 501))  # no gap where a number is absent
    assert batch.where("param = 'message_1'").where(F.col("value").contains("Hello n0, order 0")).count() == 3


def test_dispatch_uses_the_newest_snapshot(spark, tmp_path):
    """A template stored between two micro-batches is used by the second; a batch run again uses the version it used; the
    source is scanned once for both sinks."""
    catalogue = lambda text: spark.createDataFrame([("t", "T", text, "keep")], "template_code string, template_name string, template_content string, action string").withColumns({c: F.lit(None).cast("string") for c in ("template_em_type", "template_title", "template_subtitle")}).withColumn("use_failover", F.lit(False))
    spark.createDataFrame([("union_u_sender_key", "k")], "name string, key_alias string").write.parquet(str(tmp_path / "aliases"))
    spark.createDataFrame([("u", "c")], "id string, kakao_channel_id string").write.parquet(str(tmp_path / "channels"))
    lookups = dispatch.newest_lookups(spark, str(tmp_path / "catalogue"), str(tmp_path / "aliases"), str(tmp_path / "channels"))
    (tmp_path / "in").mkdir()
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    for k in range(2):
        writers.write_template_snapshot(catalogue(f"text {k} #{{2}}#{{10}}"), str(tmp_path / "catalogue"), k + 1)
        (tmp_path / f"in/{k}.json").write_text('{"unionId":"u","templateCode":"t","recipients":[{"phoneNumber":"010","variables":{"b":"x","10":"#{b}","2":"#{10}"}}]}\n{broken\n')
        lines = readers.request_lines(spark, str(tmp_path / "in"), stream=True)
        assert dispatch.stream_dispatch(lines.mapInPandas(counted, lines.schema), lookups, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(WAIT)
    sent = spark.read.parquet(str(tmp_path / "out/outbox")).select("batch_id", F.inline("params")).where("param = 'message_1'")
    assert {(r["batch_id"], r["value"]) for r in sent.collect()} == {(0, "text 0 xx"), (1, "text 1 xx")}
    assert reads.value == 4
    assert lookups(str(tmp_path / "out/lookups/batch_id=0"))[0].first()["template_content"].startswith("text 0")


def test_request_lines_whatever_the_splits(spark, tmp_path):
    """Splits of 1 KB and of 128 MB give the same lines of each file, blank and long ones included."""
    (tmp_path / "in").mkdir()
    texts = [[json.dumps({"unionId": f"{f}-{k}", "recipients": [{"name": "x" * (k * 37 % 3000)}]}) if k % 7 else "" for k in range(200)] for f in range(2)]
    for f, part in enumerate(texts):
        (tmp_path / f"in/{f}.json").write_bytes(("\r\n" if f else "\n").join(part).encode() + b"\n")
    size, found = "spark.sql.files.maxPartitionBytes", []
    held = spark.conf.get(size)
    try:
        for bytes_ in ("1k", "128m"):
            spark.conf.set(size, bytes_)
            rows = readers.read_requests(spark, str(tmp_path / "in"))
            found.append({(r["union_id"], r["ingest_file"][-6:], r["ingest_line"]) for r in rows.collect()})
            splits = readers.request_lines(spark, str(tmp_path / "in")).select("ingest_file", "ingest_block").distinct().count()
            assert splits > 100 if bytes_ == "1k" else splits == 2
    finally:
        spark.conf.set(size, held)
    assert found[0] == found[1] == {(f"{f}-{k}", f"{f}.json", k) for f in range(2) for k in range(200) if k % 7}


def test_dispatch_shuffles_no_recipient(spark, tmp_path):
    """Before the outbox gathers batches, only lookups and counts of lines are exchanged."""
    (tmp_path / "r.json").write_text('{"unionId":"u","templateCode":"t","recipients":[{"phoneNumber":"1"}]}\n')
    lookups = (spark.createDataFrame([("t", "T", "c", "n", "x", "y", False)], "template_code string, template_name string, template_content string, template_em_type string, template_title string, template_subtitle string, use_failover boolean"),
        spark.createDataFrame([("union_u_sender_key", "k")], "name string, key_alias string"), spark.createDataFrame([("u", "c")], "id string, kakao_channel_id string"))
    plan = dispatch.outbox(dispatch.resolved(dispatch.checked(readers.read_requests(spark, str(tmp_path / "r.json"))), lookups))._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert exchanges and all(any(f"hashpartitioning({k}#" in x for k in ("template_code", "name", "id", "ingest_file")) for x in exchanges)


def test_settlement_stream(spark, tmp_path):
    """Answers that are split over files, come twice, come too late, or never."""
    t = datetime.datetime(2024, 1, 1)
    at = lambda s: (t + datetime.timedelta(seconds=s)).isoformat()
    sent = [(1, 0, 500, 2, at(0)), (1, 1, 20, 2, at(1)), (2, 0, 10, 1, at(2)), (3, 0, 7, 1, at(3)), (4, -1, 0, 0, at(4)), (5, 0, 9, 1, at(5))]
    ok = lambda n: {"code": 0, "info": {"scnt": n - 1, "fcnt": 1, "total": 9}}
    answers = [[(1, 0, at(30), ok(500)), (2, 0, at(40), {"code": -5, "message": "no"})], [(1, 0, at(31), ok(400)), (3, 0, at(900), ok(7))], [(1, 1, at(200), ok(20))]]
    days = [[(-d, 0, 1, 1, at(86400 * d))] for d in (1, 2)]
    put = lambda name, k, rows: ((tmp_path / name).mkdir(exist_ok=True), (tmp_path / f"{name}/{k}.json").write_text("\n".join(map(json.dumps, rows))), os.utime(tmp_path / f"{name}/{k}.json", (1.7e9 + 10 * k,) * 2))
    for k, rows in enumerate([sent, [], [], *days]):
        put("sent", k, [dict(zip(("request_id", "batch_index", "batch_size", "n_batches", "sent_ts"), r)) for r in rows])
    for k, rows in enumerate([*answers, *[[(-d, 0, at(86400 * d), {})] for d in (1, 2)]]):
        put("answers", k, [{"request_id": r, "batch_index": b, "answered_ts": a, **x} for r, b, a, x in rows])
    shape = "request_id long, template_code string, template_found boolean, recipient_count long, union_id string, sender_id string, sender_alias string, channel_name string, template_name string, template_content string, notice_id string"
    requests = spark.createDataFrame([(k, "t", k != 4, n, *["x"] * 7) for k, n in ((1, 520), (2, 10), (3, 7), (4, 30), (5, 9), (6, 1))], shape)
    for _ in range(2):
        query = settlement.stream_settlement(readers.read_sent_batches(spark, str(tmp_path / "sent"), 1), readers.read_answers(spark, str(tmp_path / "answers"), 1), requests, F.lit(t).cast("timestamp"), str(tmp_path / "ledger"), str(tmp_path / "c"), wait="5 minutes")
        assert query.awaitTermination(WAIT)
    got = {r["request_id"]: (r["success"], r["success_count"], r["fail_count"], len(r["batch_results"]), float(r["total_cost"])) for r in readers.read_ledger(spark, str(tmp_path / "ledger")).collect()}
    assert got == {1: (True, 518, 2, 2, 518 * 9), 2: (False, 0, 10, 1, 0), 3: (False, 0, 7, 1, 0), 4: (False, 0, 30, 0, 0), 5: (False, 0, 9, 1, 0)}
    errors = {r["request_id"]: r["batch_results"][0]["error"] for r in readers.read_ledger(spark, str(tmp_path / "ledger")).where("request_id in (2, 3)").collect()}
    assert errors == {2: "no", 3: "NO_RESPONSE"}


def _finished(spark, keys):
    return spark.createDataFrame([(k, datetime.date(2024, 1, 1 + k % 2)) for k in keys], "request_id long, sent_date date")


def test_ledger_replay(spark, tmp_path):
    rows = _finished(spark, range(10))
    rows.write.parquet(str(tmp_path / "in"))
    people = spark.createDataFrame([(k, n) for k in range(12) for n in range(3)], "request_id long, seq long")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for run in ("a", "b"):
        assert ledger.stream_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / run), recipients=people).awaitTermination(WAIT)
    assert sorted(map(tuple, readers.read_ledger(spark, str(tmp_path / "ledger")).select("request_id", "sent_date").collect())) == sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, readers.read_recipients(spark, str(tmp_path / "ledger")).select("request_id", "seq").collect())) == [(k, n) for k in range(10) for n in range(3)]


def test_ledger_job_that_dies_between_its_tables(spark, tmp_path, monkeypatch):
    """Readers see neither half of a commit that was not finished; the replay brings both tables, whole and once."""
    path, people = str(tmp_path / "l"), spark.createDataFrame([(k, n) for k in range(6) for n in range(2)], "request_id long, seq long")
    assert readers.read_ledger(spark, path) is None and readers.read_recipients(spark, path) is None
    writers.write_send_ledger(_finished(spark, [0, 1]), path, people)
    put, calls = writers._put, []

    def dies(rows, where):
        calls.append(where)
        if where.endswith("/recipients"):
            raise RuntimeError("lost")
        put(rows, where)

    keys = lambda rows: sorted(r["request_id"] for r in rows.collect())
    for _ in range(2):
        monkeypatch.setattr(writers, "_put", dies)
        with pytest.raises(RuntimeError):
            writers.write_send_ledger(_finished(spark, range(6)), path, people)
        assert keys(readers.read_ledger(spark, path)) == [0, 1] and keys(readers.read_recipients(spark, path)) == [0, 0, 1, 1]
    assert len(calls) == 4
    monkeypatch.setattr(writers, "_put", put)
    for _ in range(2):
        writers.write_send_ledger(_finished(spark, range(6)), path, people)
        assert keys(readers.read_ledger(spark, path)) == list(range(6)) and keys(readers.read_recipients(spark, path)) == sorted([*range(6)] * 2)


def test_snapshots_and_sources(spark, tmp_path):
    assert writers.newest_snapshot(spark, str(tmp_path / "s")) is None
    rows = spark.createDataFrame([("a", "update"), ("b", "delete")], "template_code string, action string")
    writers.write_template_snapshot(rows, str(tmp_path / "s"), 1)
    writers.write_template_snapshot(rows.where("template_code = 'b'").withColumn("action", F.lit("keep")), str(tmp_path / "s"), 2)
    assert [r[0] for r in writers.newest_snapshot(spark, str(tmp_path / "s")).collect()] == ["b"]
    (tmp_path / "p.json").write_text(json.dumps({"code": 0, "list": [{"templtCode": "a", "templtName": "A", "buttons": [{"name": "x"}]}, {"templtCode": "b"}]}) + "\n" + json.dumps({"code": 1, "list": [{"templtCode": "c"}]}) + "\n")
    got = readers.read_provider_templates(spark, str(tmp_path / "p.json"))
    assert [(r["template_code"], r["pos"], r["template_name"]) for r in got.collect()] == [("a", 0, "A"), ("b", 1, None)]
    (tmp_path / "r.json").write_text('{"unionId":"u","templateCode":"t","recipients":[{"phoneNumber":"1","variables":{"k":"1","k":"2"}}]}\n{broken\n')
    found = readers.read_requests(spark, str(tmp_path / "r.json")).collect()
    assert sum(r["corrupt_record"] is not None for r in found) == 1
    assert next(r for r in found if r["union_id"])["recipients"][0]["variables"] == '{"k":"1","k":"2"}'
    (tmp_path / "l.txt").write_text("[2024-01-01 00:00:01] [INFO] GET /a - 200 (12ms)\n")
    assert readers.read_access_log(spark, str(tmp_path / "l.txt")).first()["path"] == "/a"


def test_equal_requests_have_two_ids(spark, tmp_path):
    line = json.dumps({"unionId": "u", "templateCode": "t", "recipients": [{"phoneNumber": "1"}]})
    (tmp_path / "r.json").write_text(f"{line}\n\n{line}\n")
    ids = [[r["request_id"] for r in dispatch.checked(readers.read_requests(spark, str(tmp_path / "r.json"))).orderBy("ingest_line").collect()] for _ in range(2)]
    assert len(set(ids[0])) == 2 and ids[0] == ids[1]


def test_outbox_replay(spark, tmp_path):
    """A replay adds nothing, other runs of the day and of other days stay, and only the day's partitions are read."""
    rows = spark.createDataFrame([(r, b) for r in range(30) for b in range(2)], "request_id long, batch_index long")
    path = str(tmp_path / "o")
    for part, day in ((rows.where("request_id < 10"), "2024-01-01"), (rows, "2024-01-01"), (rows, "2024-01-01"), (rows.where("request_id < 3"), "2024-01-02")):
        writers.write_outbox(part, path, run_date=day)
    found = spark.read.parquet(path)
    assert sorted(map(tuple, found.where("run_date = '2024-01-01'").select("request_id", "batch_index").collect())) == sorted(map(tuple, rows.collect()))
    assert found.where("run_date = '2024-01-02'").count() == 6
    marked = rows.withColumns({"run_date": F.lit("2024-01-02").cast("date"), "bucket": writers.bucket_of(F.col("request_id"))})
    plan = writers.unsent(marked, found, "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "run_date" in x)
    assert "PartitionFilters: [isnotnull(run_date" in scan and "2024-01-02" in scan
    with pytest.raises(ValueError):
        writers.write_outbox(rows, path)


def test_late_events_are_kept_and_counted(spark, tmp_path):
    """Over many more micro-batches than a query's progress remembers: the listener's count is exact, and the gate's rows
    are those that come behind the watermark; none of the accepted ones is late for the state."""
    t, key = datetime.datetime(2024, 1, 1), "spark.sql.streaming.numRecentProgressUpdates"
    (tmp_path / "in").mkdir()
    newest, late = None, set()
    for k in range(25):
        events = [(100 * k + n, 60 * k - (7200 if n == 3 and k > 2 else 0)) for n in range(5)]  # minutes move on; one of five comes two hours late
        if newest is not None:
            late |= {e for e, s in events if s <= newest - 3600}
        newest = max(s for _, s in events) if newest is None else max(newest, max(s for _, s in events))
        (tmp_path / f"in/{k:02d}.json").write_text("\n".join(json.dumps({"job_id": e, "event_id": e, "event_ts": (t + datetime.timedelta(seconds=s)).isoformat(), "status": "pending"}) for e, s in events))
        os.utime(tmp_path / f"in/{k:02d}.json", (1.7e9 + 10 * k,) * 2)
    assert len(late) == 22
    held = spark.conf.get(key)
    spark.conf.set(key, "3")
    told = job_state.LateEvents()
    spark.streams.addListener(told)
    try:
        fold = lambda events, name: job_state.stream_job_state(events, "1 hour").writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query = fold(readers.read_job_events(spark, str(tmp_path / "in"), stream=True, files=1), "c1")
        assert query.awaitTermination(WAIT) and told.of(query) == len(late)
        assert len(query.recentProgress) <= 3
        assert job_state.gate(readers.read_job_events(spark, str(tmp_path / "in"), stream=True, files=1), str(tmp_path / "g"), str(tmp_path / "c2"), "1 hour").awaitTermination(WAIT)
        assert {(r["event_id"], r["reject_code"]) for r in spark.read.parquet(str(tmp_path / "g/late")).collect()} == {(e, "LATE") for e in late}
        good = spark.readStream.schema(readers.JOB_EVENT).option("maxFilesPerTrigger", 5).parquet(str(tmp_path / "g/accepted"))
        query = fold(good, "c3")
        assert query.awaitTermination(WAIT) and told.of(query) == 0
        assert spark.read.parquet(str(tmp_path / "g/accepted")).count() == 125 - len(late)
    finally:
        spark.streams.removeListener(told)
        spark.conf.set(key, held)


def test_access_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda h, m, path, status: f"[2024-01-01T{h:02d}:{m:02d}:00.000Z] [INFO] GET {path} - {status} (10ms)"
    files = [[line(0, 5, "/a", 200), "[2024-01-01T00:05:00.000Z] GET /a", "Server listening", ""], [line(0, 50, "/a", 500), line(1, 10, "/b", 200)], [line(2, 0, "/a", 200)], [line(9, 0, "/a", 200), line(0, 1, "/a", 200)], [line(9, 1, "/a", 200)]]
    for k, rows in enumerate(files):
        (tmp_path / f"in/{k}.txt").write_text("\n".join(rows) + "\n")
        os.utime(tmp_path / f"in/{k}.txt", (1.7e9 + 10 * k,) * 2)
    for query in access_log.stream_access_log(readers.access_lines(spark, str(tmp_path / "in"), stream=True, files=1), str(tmp_path / "out"), str(tmp_path / "c")):
        assert query.awaitTermination(WAIT)
    got = {(r["window_start"].hour, r["path"], r["calls"], r["errors"], r["duration_ms"]) for r in spark.read.parquet(str(tmp_path / "out/levels")).collect()}
    assert got == {(0, "/a", 2, 1, 20), (1, "/b", 1, 0, 10), (2, "/a", 1, 0, 10)}  # the line of 0:01 comes behind the watermark
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()] == [("Server listening", "NO_ACCESS_LINE")]


class _Held:
    """A state store of one job that notes what it is asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), []

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        def ask(x=None):
            self.asked.append(name)
            if name == "get":
                return self.value
            if name in ("update", "clear"):
                self.value = x
            if name == "registerTimer":
                self.timers.add(x)
            if name == "deleteTimer":
                self.timers.remove(x)

        return ask


def test_a_job_costs_few_questions_to_its_state():
    """Three for a new job, one timer at any time, and a timer of a run with a shorter time-out fails no job."""
    held, job = _Held(), job_state.JobProcessor(time_out_ms=1000, retention_ms=5000, abandon_ms=9000)
    job.init(held)
    row = lambda ms, event, status, error=None: (7, None, ms * 1000, event, status, error)
    assert [r["status"] for r in job.handleInputRows((7,), iter([row(0, 1, "pending")]), None)] == ["pending"]
    assert held.asked == ["get", "registerTimer", "update"] and held.timers == {9000}
    list(job.handleInputRows((7,), iter([row(10, 2, "processing"), row(9, 3, "pending")]), None))
    assert held.timers == {1010}

    class Expired:
        def __init__(self, at):
            self.getExpiryTimeInMs = lambda: at

    assert list(job.handleExpiredTimer((7,), None, Expired(500))) == [] and held.timers == {1010}
    (out,) = job.handleExpiredTimer((7,), None, Expired(1010))
    assert (out["status"], out["error"], out["timed_out"], out["completed_us"]) == ("failed", "TIME_OUT", True, 1_010_000)
    assert 6010 in held.timers
    assert list(job.handleExpiredTimer((7,), None, Expired(6010))) == [] and held.value is None


def test_a_request_in_parts_is_one_request(spark, tmp_path, sf_dir):
    """Parts of odd sizes, in any order, give what the whole line gives: batches, flags (also of batches that lie across
    parts), and rejects; an invalid request is rejected once."""
    lookups = tuple(frame(spark, sf_dir, n) for n in ("template_target", "key_aliases", "channels"))
    people = [{"phoneNumber": None if i % 7 == 3 else f"010-{i:08d}", "name": f"n{i}", "failoverSubject": "s", "failoverMessage": "m" if i in (700, 1500) else None} for i in range(1900)]
    head = {"unionId": "1", "templateCode": "Brand#2"}
    cuts = [0, 3, 450, 450, 1101, 1105, 1900]
    parts = [json.dumps(head | {"requestKey": "k", "first": a, "recipients": people[a:z]}) for a, z in zip(cuts, cuts[1:])]
    bad = [json.dumps({"unionId": "", "templateCode": "t", "requestKey": "bad", "first": a, "recipients": people[:2]}) for a in (0, 2)]
    (tmp_path / "parts.json").write_text("\n".join([*parts[::-1], *bad]) + "\n")
    (tmp_path / "whole.json").write_text(json.dumps(head | {"recipients": people}) + "\n" + json.dumps({"unionId": "", "templateCode": "t", "recipients": people[:4]}) + "\n")
    found = []
    for name in ("parts", "whole"):
        judged = dispatch.checked(readers.read_requests(spark, str(tmp_path / f"{name}.json")))
        out = dispatch.outbox(dispatch.resolved(judged, lookups))
        assert out.select("request_id").distinct().count() == 1
        left = dispatch.rejects(judged).select("seq", "reject_code").collect()
        found.append((sorted(map(tuple, out.drop("request_id").collect())), sorted((r["reject_code"], r["seq"] or -1) for r in left)))
    assert found[0] == found[1]
    assert {r[1] for r in found[0][0] if r[2] == "failover"} == {0} and [r[3] for r in found[0][0] if r[2] == "failover"] == ["N", "Y", "Y", "N"]


def test_requests_are_written_in_lines_of_a_batch(spark, sf_dir, monkeypatch):
    """No line of the dispatched requests holds more recipients than a batch, whatever the campaign's size."""
    from herald.plans import flows

    monkeypatch.setattr(flows.batches, "BATCH", 20)
    lines = flows._request_lines(spark, sf_dir).collect()
    assert max(r["value"].count('"phoneNumber"') for r in lines) == 20 and sum('"requestKey"' in r["value"] for r in lines) > 25


def test_rejects_of_parts(spark, tmp_path):
    """A recipient's place is that in the request, and an invalid request has one reject, by its first part."""
    part = lambda key, union, first, *phones: json.dumps({"unionId": union, "templateCode": "t", "requestKey": key, "first": first, "recipients": [{"phoneNumber": p} for p in phones]})
    lines = [part("a", "u", 2, "1", None), part("a", "u", 0, None, "1"), part("b", "", 2, None), part("b", "", 0, "1", "1"), part("c", "u", 0), part("c", "u", 0)]
    (tmp_path / "r.json").write_text("\n".join(lines) + "\n")
    found = dispatch.rejects(dispatch.checked(readers.read_requests(spark, str(tmp_path / "r.json")))).collect()
    assert sorted((r["ingest_line"], r["seq"], r["reject_code"]) for r in found) == [(0, 3, "NO_PHONE"), (1, 0, "NO_PHONE"), (3, None, "INVALID_PARAMS"), (4, None, "INVALID_PARAMS")]
