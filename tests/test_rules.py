"""Hand-written rows for the column rules and operators, and properties of batches and merges."""

import datetime

import pytest
from pyspark.sql import functions as F

from herald.functions import columns as fn
from herald.operators import access_log, batches, catalog, delivery, jobs, rendering, requests, resolve


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("phone, normal, valid", [("+82 10-1234-5678", "01012345678", True), ("+82 010-1234-5678", "001012345678", False), ("82", "0", False), ("０１０１２３４５６７８", "", False), (None, None, False), ("019-123-4567", "0191234567", True), ("0121234567", "0121234567", False)])
def test_phone(spark, phone, normal, valid):
    assert one(spark, phone, "string", fn.normalize_phone) == normal
    assert one(spark, phone, "string", fn.is_valid_phone) is valid


@pytest.mark.parametrize("text, entries, out", [
    ("#{a}", [("a", "#{b}"), ("b", "Z")], "Z"), ("#{a}", [("b", "Z"), ("a", "#{b}")], "#{b}"), ("x#{a}", [("a", None)], "xnull"), ("#{missing}", [("a", "1")], "#{missing}"),
    ("#{a}#{a}", [("a", "$&")], "$&$&"), ("plain", None, "plain"), (None, [("a", "1")], None), ("#{a.b} axb", [("a.b", "1")], "1 axb"),
])
def test_substitute(spark, text, entries, out):
    df = spark.createDataFrame([(text, entries)], "t string, e array<struct<key:string,value:string>>")
    assert df.select(fn.substitute_vars(F.col("t"), F.col("e")).alias("y")).first()["y"] == out


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (499, [499]), (500, [500]), (501, [500, 1]), (1000, [500, 500]), (1001, [500, 500, 1])])
def test_chunks(spark, n, sizes):
    assert [len(x) for x in one(spark, list(range(n)), "array<int>", batches.chunk_array)] == sizes


def test_size_guard(spark):
    rows = spark.createDataFrame([("u", "t", 500), ("u", "t", 501), ("", "t", 501), ("u", None, 1), ("u", "t", 0)], "union_id string, template_code string, recipient_count int")
    got = [r["reject_code"] for r in requests.sync_size_guard(requests.validate_requests(rows)).collect()]
    assert got == [None, "TOO_MANY_RECIPIENTS", "INVALID_PARAMS", "INVALID_PARAMS", "INVALID_PARAMS"]


def test_batches_of_large_and_gapped_campaigns(spark):
    rows = spark.range(2503).select((F.col("id") % 2).alias("request_id"), (F.col("id") * 3).alias("seq"))
    got = batches.assign_batches(rows, size=500, span=700).toPandas()
    assert len(got) == 2503
    for _, g in got.sort_values("seq").groupby("request_id"):
        place = range(len(g))
        assert list(g["batch_index"]) == [p // 500 for p in place] and list(g["slot"]) == [p % 500 + 1 for p in place]


def test_messages_and_emphasis(spark):
    none = F.array().cast("array<struct<key:string,value:string>>")
    df = spark.createDataFrame([("", "", "name"), ("c", "t", "n"), (None, "t", "n")], "c string, t string, n string")
    assert [r[0] for r in df.select(rendering.pick_message(F.col("c"), F.col("t"), F.col("n"), none)).collect()] == ["name", "c", "t"]
    df = spark.createDataFrame([(None, "TEXT", "", "sub"), (None, "NONE", "a", "b"), ("own", "NONE", None, None)], "o string, k string, t string, s string")
    assert [r[0] for r in df.select(rendering.pick_emphasis(F.col("o"), F.col("k"), F.col("t"), F.col("s"), none)).collect()] == ["sub", None, "own"]


def test_failover(spark):
    none = F.array().cast("array<struct<key:string,value:string>>")
    rows = [("Y", None, "lone", False, "t", "n", "c"), ("Y", None, "lone", True, "", "n", "c"), ("Y", "s", "m", True, "t", "n", "c"), ("N", "s", "m", True, "t", "n", "c"), ("Y", "s", "", True, "t", "n", "")]
    df = spark.createDataFrame(rows, "f string, s string, m string, u boolean, t string, n string, c string")
    got = [r[0] and tuple(r[0]) for r in df.select(rendering.pick_failover(*[F.col(x) for x in "fsmutnc"], none)).collect()]
    assert got == [None, ("n", "c"), ("s", "m"), None, None]


def test_outcomes(spark):
    rows = [(1, 0, 10, 0, None, None), (1, 1, 10, 0, None, (None, None, None)), (1, 2, 10, None, None, None), (1, 3, 10, -1, "bad", (5, 5, 5)), (1, 4, 10, 0, None, (9, 1, 81))]
    df = spark.createDataFrame(rows, "request_id int, batch_index int, batch_size bigint, code int, message string, info struct<scnt:bigint,fcnt:bigint,total:bigint>")
    got = [(r["success"], r["success_count"], r["fail_count"], float(r["actual_cost"]), r["error"]) for r in delivery.batch_outcome(df).collect()]
    assert got == [(False, 0, 10, 0, "NO_RESPONSE"), (True, 0, 0, 0, None), (False, 0, 10, 0, "NO_RESPONSE"), (False, 0, 10, 0, "bad"), (True, 9, 1, 81, None)]


def _catalog(spark, rows):
    return spark.createDataFrame(rows, "template_code string, template_name string, use_failover boolean")


def test_merge(spark):
    target = _catalog(spark, [("a", "A", True), ("b", "B", None), (None, "N", True)])
    empty = spark.createDataFrame([], "template_code string, pos int, template_name string")
    assert {r["action"] for r in catalog.merge_template_catalog(empty, target, ["template_name"]).collect()} == {"keep"}
    assert catalog.stale_templates(target, empty).count() == 0
    source = spark.createDataFrame([("a", 0, None), ("c", 1, "C1"), ("c", 2, "C2")], "template_code string, pos int, template_name string")
    merged = catalog.merge_template_catalog(source, target, ["template_name"])
    assert {(r["template_code"], r["action"], r["template_name"], r["use_failover"]) for r in merged.collect()} == {("a", "update", "A", True), ("b", "delete", "B", False), ("c", "insert", "C2", False), (None, "keep", "N", True)}
    assert tuple(catalog.merge_counts(source, merged).first()) == (1, 2, 1, 3)
    again = catalog.merge_template_catalog(source, merged.where("action <> 'delete'").drop("action"), ["template_name"])
    assert {r["action"] for r in again.collect()} == {"update", "keep"}
    with pytest.raises(ValueError):
        catalog.check_unique(_catalog(spark, [("a", "A", True), ("a", "B", True)]))


def test_unique_by_key(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    assert [tuple(r) for r in resolve.unique_by_key(rows, "k").collect()] == [("b", 3)]


def test_job_fold_and_retention(spark):
    t = datetime.datetime(2024, 1, 1)
    at = lambda ms: t + datetime.timedelta(milliseconds=ms)
    events = spark.createDataFrame([(1, 1, at(0), "pending", None), (1, 2, at(1), "processing", None), (1, 3, at(300_002), "failed", "E"), (1, 4, at(300_003), "completed", None), (2, 5, at(0), "processing", None)], "job_id long, event_id long, event_ts timestamp_ntz, status string, error string")
    state = jobs.fold_job_state(events)
    first = {r["job_id"]: r for r in jobs.job_timeout(state, F.lit(at(300_000)).cast("timestamp_ntz")).collect()}
    assert (first[1]["status"], first[1]["error"], first[1]["timed_out"]) == ("completed", "E", True) and first[2]["timed_out"] is False
    hour = 300_003 + 3_600_000
    left = lambda ms: {r["job_id"] for r in jobs.expire_completed_jobs(state, F.lit(at(ms)).cast("timestamp_ntz")).collect()}
    assert left(hour) == {1, 2} and left(hour + 1) == {2}


def test_access_lines(spark):
    lines = spark.createDataFrame([("[2024-01-01 00:00:01] [INFO] GET /a - 404 (12ms)",), ("junk",), ("[2024-01-01 00:00:01] GET /a",), (None,), (" ",)], "value string")
    assert [(r["level"], r["method"], r["path"], r["status"], r["duration_ms"]) for r in access_log.parse_access_log(lines).collect()] == [("ERROR", "GET", "/a", 404, 12)]
    assert [tuple(r) for r in access_log.access_log_rejects(lines).collect()] == [("junk", "NO_ACCESS_LINE")]


@pytest.mark.parametrize("text, hour", [("2024-02-01 04:05:06", 4), ("2024-02-01T04:05:06", 4), ("2024-02-01T04:05:06Z", 4), ("2024-02-01T04:05:06.123Z", 4), ("2024-02-01T04:05:06+09:00", 19), ("2024-02-01", 0), (" 2024-02-01 04:05 ", 4), ("2024-02", 0), ("04:05:06", None), ("on day 3", None), ("2024-13-01", None), ("", None), (None, None)])
def test_creation_dates(spark, text, hour):
    got = one(spark, text, "string", fn.parse_cdate)
    assert got is None if hour is None else got.hour == hour


def test_absent_and_empty_dates_are_no_rejects(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "soon"), ("d", "2024-02-01T00:00:00Z")], "template_code string, cdate string")
    good, bad = catalog.split_bad_dates(rows)
    assert {r["template_code"]: r["cdate"] is None for r in good.collect()} == {"a": True, "b": True, "d": False} and [r["template_code"] for r in bad.collect()] == ["c"]


def test_fields_in_three_states(spark):
    """Absent keeps, null clears, a value replaces; the creation date is always written; pages come before positions."""
    raw = ['{"templtCode":"a","templtName":"A2","comments":null,"unknown":1}', '{"templtCode":"b","comments":"new","cdate":"2024-02-01T00:00:00Z","buttons":[{"name":"x"}]}', '{"templtCode":"a","templtName":"A1","comments":"late"}']
    pages = spark.createDataFrame([(2, 0, raw[:2]), (1, 0, raw[2:]), (3, -1, raw)], "page long, code int, list array<string>")
    listed = catalog.map_provider_template(catalog.explode_templates(catalog.unwrap_success_envelope(pages)))
    assert set(listed.columns) == {"page", "pos", "present", *catalog.FIELDS.values()} and listed.count() == 3
    stored = spark.createDataFrame([("a", "A", "old", "kept.png", True)], "template_code string, template_name string, comments string, template_image_name string, use_failover boolean").withColumn("cdate", F.lit("2020-01-01").cast("timestamp"))
    merged = catalog.merge_template_catalog(catalog.split_bad_dates(listed)[0], stored, catalog.UPDATED, catalog.ALWAYS, F.lit("2024-03-01").cast("timestamp"))
    rows = {r["template_code"]: r for r in merged.collect()}
    a, b = rows["a"], rows["b"]
    assert (a["action"], a["template_name"], a["comments"], a["template_image_name"], a["cdate"], a["use_failover"], a["synced_at"].month) == ("update", "A2", None, "kept.png", None, True, 3)
    assert (b["action"], b["template_name"], b["comments"], b["cdate"].year, b["buttons"][0]["name"], b["use_failover"]) == ("insert", None, "new", 2024, "x", False)
    assert set(merged.columns) == {"action", "synced_at", "use_failover", *catalog.FIELDS.values()}


@pytest.mark.parametrize("text, entries", [
    ('{"10":"x","2":"y","b":"z","a":null}', [("2", "y"), ("10", "x"), ("b", "z"), ("a", None)]), ('{"b":"1","a":"2","b":"3"}', [("b", "3"), ("a", "2")]), ('{"01":"x","-1":"y","1":"z","4294967295":"u","4294967294":"v"}', [("1", "z"), ("4294967294", "v"), ("01", "x"), ("-1", "y"), ("4294967295", "u")]),
    ('{"n":5,"t":true,"e":""}', [("n", "5"), ("t", "true"), ("e", "")]), ("{}", []), (None, None),
])
def test_ordered_variables(spark, text, entries):
    got = one(spark, text, "string", fn.ordered_variables)
    assert (None if got is None else [tuple(e) for e in got]) == entries


def test_depth_of_a_busy_minute(spark):
    """Very many events within a minute, half of them at one instant: ranges of bounded size, and the depth of one window over all."""
    n = 100_000
    events = spark.range(n).select((F.col("id") / 2).cast("bigint").alias("job_id"), F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, F.lit("pending")).otherwise("completed").alias("status"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.when(F.col("id") < n / 2, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(60))).cast("decimal(18,6)"))).alias("event_ts"))
    deltas = events.withColumn("delta", F.lit(1))
    sizes = [r["count"] for r in jobs.depth_ranges(deltas, 1000).groupBy("_hour", "_range").count().collect()]
    assert sum(sizes) == n and len(sizes) > 400 and max(sizes) < 4 * n / jobs.CUTS
    assert [r["count"] for r in jobs.depth_ranges(deltas, n).groupBy("_hour", "_range").count().collect()] == [n]
    got, want = (sorted((r["event_ts"], r["event_id"], -r["delta"], r["depth"]) for r in jobs.queue_depth_series(events, most=m).collect()) for m in (1000, 10 * n))
    assert got == want and len(got) == n
    depth = 0
    for _, _, delta, shown in got:
        depth -= delta
        assert shown == depth
