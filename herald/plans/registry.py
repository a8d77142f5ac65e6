"""Every registered query of the notification jobs, and DuckDB SQL for the same rows.

A query derives its inputs from the given tables (herald.sources.fixtures) and runs over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herald.functions import columns as fn
from herald.operators import access_log, batches, catalog, costing, delivery, jobs, rendering, requests, resolve
from herald.plans import jobs as plans
from herald.sources.fixtures import frame, with_sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
AS_OF = "2024-01-15 00:00:00"


def _query(sql: str | None = None, money: tuple[str, ...] = ()):
    """Register a query and its SQL. ``money``: decimal columns, shown as doubles in both results."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: (df := f(spark, sf_dir)).withColumns({c: df[c].cast("double") for c in money})
        if sql:
            _SQL[f.__name__] = f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in money)}) from ({sql})" if money else sql
        return f

    return add


def queries():
    from herald.plans import flows  # noqa: F401  registers the flows over files and streams

    return dict(_QUERIES)


def oracle_sql():
    from herald.plans import flows  # noqa: F401

    return dict(_SQL)


def _entries():
    return rendering.variables(("name", "name"), ("order", "var_order"), ("amount", "var_amount"))


def _responses(spark, sf_dir) -> DataFrame:
    r = frame(spark, sf_dir, "responses")
    info = F.struct(F.col("scnt"), F.col("fcnt"), F.col("total"))
    return r.select("request_id", "batch_index", "code", F.when(F.col("code") != 0, F.concat(F.lit("error "), F.col("code").cast("string"))).alias("message"), info.alias("info"))


def _resolved(spark, sf_dir) -> DataFrame:
    return plans.resolved_requests(*[frame(spark, sf_dir, "requests"), requests.recipient_count(frame(spark, sf_dir, "recipients")), *[frame(spark, sf_dir, n) for n in ("template_target", "key_aliases", "channels")]])


def _planned(spark, sf_dir) -> dict[str, DataFrame]:
    return plans.plan_campaign(*[frame(spark, sf_dir, n) for n in ("requests", "recipients", "template_target", "key_aliases", "channels")], _entries())


def _settled(spark, sf_dir, priced=False) -> dict[str, DataFrame]:
    return plans.settle_campaign(_resolved(spark, sf_dir), frame(spark, sf_dir, "batches"), _responses(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"), frame(spark, sf_dir, "prices") if priced else None)


# Pieces of SQL that several oracles share.
_PHONE = "regexp_replace(regexp_replace(phone_number, '[^0-9]', '', 'g'), '^82', '0')"
_SUB = "replace(replace(replace({}, '#{{name}}', coalesce(name, 'null')), '#{{order}}', coalesce(var_order, 'null')), '#{{amount}}', coalesce(var_amount, 'null'))"
_COUNTS = "counts as (select request_id, cast(count(*) as bigint) as recipient_count from recipients group by 1)"
_RESOLVED = f"""{with_sql('requests', 'recipients', 'template_target', 'key_aliases', 'channels')}, {_COUNTS},
accepted as (select r.*, coalesce(recipient_count, 0) as recipient_count from requests r left join counts using (request_id)
  where nullif(union_id, '') is not null and nullif(template_code, '') is not null and coalesce(recipient_count, 0) > 0),
one_template as (select * from template_target where template_code in (select template_code from template_target group by 1 having count(*) = 1)),
one_alias as (select name, nullif(any_value(key_alias), '') as key_alias from key_aliases group by 1 having count(*) = 1),
one_channel as (select id, nullif(any_value(kakao_channel_id), '') as kakao_channel_id from channels group by 1 having count(*) = 1),
resolved as (select a.*, t.template_name, t.template_content, t.template_em_type, t.template_title, t.template_subtitle, t.use_failover, t.template_code is not null as template_found,
  coalesce(k.key_alias, 'default') as sender_alias, k.key_alias is null as is_default,
  case when k.key_alias is null then 'default_channel' else coalesce(c.kakao_channel_id, 'default_channel') end as channel_name
  from accepted a left join one_template t on a.template_code = t.template_code left join one_alias k on k.name = 'union_' || a.union_id || '_sender_key' left join one_channel c on c.id = a.union_id)"""
_BATCHED = """placed as (select *, row_number() over (partition by request_id order by seq) - 1 as place from recipients where phone_number is not null),
batched as (select p.*, r.template_name, r.template_content, r.template_em_type, r.template_title, r.template_subtitle, r.use_failover, cast(place // 500 as bigint) as batch_index, cast(place % 500 + 1 as bigint) as slot
  from placed p join resolved r on p.request_id = r.request_id where r.template_found),
flags as (select request_id, batch_index, case when bool_or(coalesce(use_failover, false) or nullif(failover_message, '') is not null) then 'Y' else 'N' end as failover from batched group by 1, 2)"""
_RENDERED = f"""{_RESOLVED}, {_BATCHED},
chosen as (select b.*, f.failover, coalesce(nullif(content, ''), nullif(template_content, ''), nullif(template_name, '')) as m,
  case when template_em_type = 'TEXT' then coalesce(nullif(template_title, ''), nullif(template_subtitle, '')) end as e,
  case when f.failover = 'Y' then case when nullif(failover_subject, '') is not null and nullif(failover_message, '') is not null then 1
    when coalesce(use_failover, false) and nullif(template_content, '') is not null then 2 end end as pair from batched b join flags f on b.request_id = f.request_id and b.batch_index = f.batch_index),
rendered as (select request_id, seq, batch_index, slot, {_PHONE} as receiver, template_name as subject, {_SUB.format('e')} as emtitle, {_SUB.format('m')} as message, failover,
  case pair when 1 then {_SUB.format('failover_subject')} when 2 then {_SUB.format("coalesce(nullif(template_title, ''), nullif(template_name, ''))")} end as fsubject,
  case pair when 1 then {_SUB.format('failover_message')} when 2 then {_SUB.format('template_content')} end as fmessage from chosen)"""
_OUTCOMES = """outcomes as (select b.request_id, b.batch_index, b.batch_size, coalesce(r.code = 0, false) as success, case when r.code = 0 then coalesce(r.scnt, 0) else 0 end as success_count, cast(0 as bigint) as sms_count,
  case when r.code = 0 then coalesce(r.fcnt, 0) else b.batch_size end as fail_count, cast(case when r.code = 0 then coalesce(r.total, 0) else 0 end as decimal(18,2)) as actual_cost,
  case when r.code = 0 then null when r.code is null then 'NO_RESPONSE' else 'error ' || cast(r.code as string) end as error
  from batches b left join responses r on b.request_id = r.request_id and b.batch_index = r.batch_index)"""
_SETTLED = f"""{with_sql('requests', 'recipients', 'template_target', 'key_aliases', 'channels', 'batches', 'responses', 'prices')}, {_RESOLVED[len(with_sql('requests', 'recipients', 'template_target', 'key_aliases', 'channels')) + 2 :]},
{_OUTCOMES}, known as (select o.* from outcomes o join resolved r on o.request_id = r.request_id where r.template_found),
per as (select request_id, count(*) as batch_count, bool_and(success) as ok, cast(sum(success_count) as bigint) as success_count, cast(sum(sms_count) as bigint) as sms_count, cast(sum(fail_count) as bigint) as fail_count,
  cast(sum(actual_cost) as decimal(18,2)) as actual_cost from known group by 1),
settled as (select r.*, coalesce(p.batch_count, 0) as batch_count, case when template_found then coalesce(ok, true) else false end as success, coalesce(success_count, 0) as success_count, coalesce(sms_count, 0) as sms_count,
  case when template_found then coalesce(fail_count, 0) else recipient_count end as fail_count, coalesce(actual_cost, cast(0 as decimal(18,2))) as actual_cost from resolved r left join per p on r.request_id = p.request_id)"""


@_query(_SETTLED + " select request_id, recipient_count, batch_count, success, success_count, fail_count, cast(success_count * 9 + sms_count * 20 as decimal(18,2)) as total_cost, actual_cost from settled", money=('total_cost', 'actual_cost'))
def campaign_outcome(spark, sf_dir):
    """settle_campaign at flat rates."""
    return _settled(spark, sf_dir)["settled"].select("request_id", "recipient_count", "batch_count", "success", "success_count", "fail_count", "total_cost", "actual_cost")


@_query(with_sql("requests", "recipients") + f", {_COUNTS} select r.request_id, coalesce(recipient_count, 0) as recipient_count, case when nullif(union_id, '') is null or nullif(template_code, '') is null or coalesce(recipient_count, 0) = 0 then 'INVALID_PARAMS' when recipient_count > 500 then 'TOO_MANY_RECIPIENTS' end as reject_code from requests r left join counts c on r.request_id = c.request_id")
def p1_p2_validate_requests(spark, sf_dir):
    counted = frame(spark, sf_dir, "requests").join(requests.recipient_count(frame(spark, sf_dir, "recipients")), "request_id", "left").withColumn("recipient_count", fn.count_or_zero(F.col("recipient_count")))
    return requests.sync_size_guard(requests.validate_requests(counted)).select("request_id", "recipient_count", "reject_code")


@_query(with_sql("recipients") + f" select request_id, seq, phone_number, {_PHONE} as receiver from recipients where regexp_matches({_PHONE}, '^01[016789][0-9]{{7,8}}$')")
def p3_filter_valid_phones(spark, sf_dir):
    return requests.filter_valid_phones(frame(spark, sf_dir, "recipients"))[0].select("request_id", "seq", "phone_number", "receiver")


@_query(with_sql("recipients") + f" select request_id, seq, {_PHONE} as receiver, coalesce(regexp_matches({_PHONE}, '^01[016789][0-9]{{7,8}}$'), false) as valid_phone from recipients")
def f1_normalize_phone(spark, sf_dir):
    return requests.with_phones(frame(spark, sf_dir, "recipients")).select("request_id", "seq", "receiver", "valid_phone")


#: Fields of the listing that are absent, null or there, by (pos + k) % 3 = 0, 1, 2.
_TRISTATE = {"template_title": 0, "template_subtitle": 1, "template_image_name": 2, "template_image_url": 0, "comments": 1}
_NAMED = {c: f for f, c in catalog.FIELDS.items()}


def _envelopes(spark, sf_dir) -> DataFrame:
    """One envelope per page of the listing (position div 5): every page that leaves 3 when divided by 4 answers an error.

    A null content is absent in every other row and null in the others; ``_TRISTATE`` fields likewise; every third
    template has a button; a field that is not stored is there too."""
    quoted = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":|\}$', ""), F.lit("null"))
    value = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c))
    absent = {c: (F.col("pos") + k) % 3 == 0 for c, k in _TRISTATE.items()} | {"template_content": F.col("template_content").isNull() & (F.col("pos") % 4 == 1), "cdate": F.col("cdate").isNull() & (F.col("pos") % 2 == 0)}
    parts = [F.when(~absent.get(c, F.lit(False)), F.concat(F.lit(f'"{_NAMED[c]}":'), value(c))) for c in _NAMED if c != "buttons"]
    button = F.when(F.col("pos") % 3 == 0, F.concat(F.lit('"buttons":[{"ordering":1,"name":"b'), F.col("pos").cast("string"), F.lit('","linkType":"WL"}]')))
    item = F.concat(F.lit("{"), F.concat_ws(",", *parts, button, F.lit('"unknown":1')), F.lit("}"))
    pages = frame(spark, sf_dir, "listed_templates").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("raw")))).alias("l"))
    return pages.select("page", F.when(F.col("page") % 4 == 3, -1).otherwise(0).alias("code"), F.transform("l", lambda x: x["raw"]).alias("list"))


_LISTED = with_sql("listed_templates") + """, listed as (select *, cast(row_number() over (partition by page order by pos) - 1 as int) as place, try_cast(cdate as timestamp) as parsed from listed_templates where page % 4 <> 3),
good as (select * from listed where cdate is null or parsed is not null)"""


def _listed(spark, sf_dir) -> DataFrame:
    return catalog.map_provider_template(catalog.explode_templates(catalog.unwrap_success_envelope(_envelopes(spark, sf_dir))))


_PLAIN = ("template_name", "status", "insp_status", "sender_key", "template_type", "template_em_type")
_SHOWN = ", ".join(("template_content", *_PLAIN, *_TRISTATE))
_BUTTON = "case when pos % 3 = 0 then 'b' || pos end as button"


def shown_templates(rows: DataFrame, *first: str) -> DataFrame:
    """All 15 fields of templates, the buttons by the name of the first."""
    return rows.withColumn("cdate", F.col("cdate").cast("timestamp_ntz")).select(*first, "template_code", "template_content", *_PLAIN, *_TRISTATE, "cdate", F.get("buttons", F.lit(0))["name"].alias("button"))


@_query(_LISTED + f" select page, place as pos, template_code, {_SHOWN}, parsed as cdate, {_BUTTON} from good")
def p4_p5_g2_provider_templates(spark, sf_dir):
    """Unwrap, flatten and rename the listing; creation dates parsed (F10)."""
    return shown_templates(catalog.split_bad_dates(_listed(spark, sf_dir))[0], "page", "pos")


@_query(_LISTED + " select place as pos, template_code, cdate, 'BAD_CDATE' as reject_code from listed where cdate is not null and parsed is null")
def f10_bad_dates(spark, sf_dir):
    """Listed templates whose creation date is malformed."""
    return catalog.split_bad_dates(_listed(spark, sf_dir))[1].select("pos", "template_code", "cdate", "reject_code")


@_query(_RESOLVED + " select request_id, template_code, template_found, template_name from resolved")
def j1_resolve_template(spark, sf_dir):
    return _resolved(spark, sf_dir).select("request_id", "template_code", "template_found", "template_name")


@_query(_RESOLVED + " select request_id, sender_alias, is_default, channel_name from resolved")
def j2_j3_resolve_sender(spark, sf_dir):
    return _resolved(spark, sf_dir).select("request_id", "sender_alias", "is_default", "channel_name")


_MERGED = f"""{with_sql('template_source', 'template_target')},
last as (select * from (select *, row_number() over (partition by template_code order by pos desc) as n from template_source) where n = 1),
merged as (select coalesce(s.template_code, t.template_code) as template_code, case when s.template_code is not null and t.template_code is not null then 'update' when s.template_code is not null then 'insert' when t.template_code is not null then 'delete' else 'keep' end as action,
  coalesce(s.template_name, t.template_name) as template_name, coalesce(s.template_content, t.template_content) as template_content, coalesce(t.use_failover, false) as use_failover from last s full outer join template_target t on s.template_code = t.template_code)"""


def _merge(spark, sf_dir) -> dict[str, DataFrame]:
    return plans.sync_templates(frame(spark, sf_dir, "template_source"), frame(spark, sf_dir, "template_target"), ["template_name", "template_content"])


@_query(_MERGED + " select * from merged")
def j4_merge_template_catalog(spark, sf_dir):
    return _merge(spark, sf_dir)["merged"].select("template_code", "action", "template_name", "template_content", "use_failover")


_STATES = {"template_content": "s.template_content is null and s.pos % 4 = 1"} | {c: f"(s.pos + {k}) % 3 = 0" for c, k in _TRISTATE.items()}
_SYNCED_FIELDS = ", ".join(f"case when s.template_code is null or {_STATES.get(c, 'false')} then t.{c} else s.{c} end as {c}" for c in ("template_content", *_PLAIN, *_TRISTATE))
_SYNCED = f"""{_LISTED}, {with_sql('stored_templates').split(' as (', 1)[0].removeprefix('with ')} as ({with_sql('stored_templates').split(' as (', 1)[1]},
last as (select * from (select *, row_number() over (partition by template_code order by page desc, pos desc) as n from good) where n = 1),
synced as (select coalesce(s.template_code, t.template_code) as template_code, case when s.template_code is null then 'delete' when t.template_code is null then 'insert' else 'update' end as action, {_SYNCED_FIELDS},
  case when s.template_code is null then t.cdate else s.parsed end as cdate, case when s.pos % 3 = 0 then 'b' || s.pos end as button, coalesce(t.use_failover, false) as use_failover,
  case when s.template_code is null then t.synced_at else timestamp '{AS_OF}' end as synced_at from last s full outer join stored_templates t on s.template_code = t.template_code)"""


def synced(spark, sf_dir, listed: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    return plans.sync_templates(catalog.split_bad_dates(listed)[0], stored, synced_at=F.lit(AS_OF).cast("timestamp"))


def shown_catalog(rows: DataFrame, *first: str) -> DataFrame:
    return shown_templates(rows, *first, "use_failover", F.col("synced_at").cast("timestamp_ntz").alias("synced_at"))


@_query(_SYNCED + " select * from synced")
def j4_sync_all_fields(spark, sf_dir):
    """sync_templates over every field of the listing: absent keeps, null clears, the creation date and the time of the sync are always written."""
    return shown_catalog(synced(spark, sf_dir, _listed(spark, sf_dir), frame(spark, sf_dir, "stored_templates"))["merged"], "action")


@_query(with_sql("template_source", "template_target") + " select template_code, template_name from template_target where template_code not in (select template_code from template_source)")
def j5_stale_templates(spark, sf_dir):
    return catalog.stale_templates(frame(spark, sf_dir, "template_target"), frame(spark, sf_dir, "template_source")).select("template_code", "template_name")


@_query(_MERGED + ", n as (select cast(count(*) filter (where action = 'insert') as bigint) as inserted, cast(count(*) filter (where action = 'delete') as bigint) as deleted from merged) select inserted, (select count(*) from template_source) - inserted as updated, deleted, (select count(*) from template_source) as total from n")
def a5_merge_counts(spark, sf_dir):
    return _merge(spark, sf_dir)["counts"]


@_query(with_sql("template_source") + " select template_code, pos, template_name, template_content from (select *, row_number() over (partition by template_code order by pos desc) as n from template_source) where n = 1")
def w2_last_source_row(spark, sf_dir):
    return catalog.last_source_row(frame(spark, sf_dir, "template_source"))


@_query(with_sql("batches", "responses") + f", {_OUTCOMES} select * from outcomes", money=('actual_cost',))
def j6_p10_batch_outcome(spark, sf_dir):
    return delivery.batch_outcome(delivery.reconcile_batches(frame(spark, sf_dir, "batches"), _responses(spark, sf_dir)))


@_query(_SETTLED + " select request_id, recipient_count, batch_count, success, success_count, sms_count, fail_count, actual_cost from settled", money=('actual_cost',))
def a1_a2_rollup_requests(spark, sf_dir):
    return _settled(spark, sf_dir)["settled"].select("request_id", "recipient_count", "batch_count", "success", "success_count", "sms_count", "fail_count", "actual_cost")


@_query(with_sql("batches", "responses") + f", {_OUTCOMES} select request_id, string_agg(batch_index || ':' || success || ':' || success_count || ':' || fail_count, ',' order by batch_index) as batch_results from outcomes group by 1")
def a3_collect_batch_results(spark, sf_dir):
    """The ordered batch structs, shown as text."""
    outcomes = delivery.batch_outcome(delivery.reconcile_batches(frame(spark, sf_dir, "batches"), _responses(spark, sf_dir)))
    shown = F.array_join(F.transform("batch_results", lambda b: F.concat_ws(":", b["batch_index"].cast("string"), b["success"].cast("string"), b["success_count"].cast("string"), b["fail_count"].cast("string"))), ",")
    return delivery.collect_batch_results(outcomes).select("request_id", shown.alias("batch_results"))


@_query(f"{_RESOLVED}, {_BATCHED} select request_id, batch_index, failover from flags")
def a4_batch_failover_flag(spark, sf_dir):
    resolved = _resolved(spark, sf_dir).where("template_found").select("request_id", "use_failover")
    sendable, _ = requests.split_null_phones(frame(spark, sf_dir, "recipients"))
    return batches.batch_failover_flag(batches.assign_batches(sendable).join(resolved, "request_id"))


@_query(with_sql("prices") + " select coalesce(max(unit_price) filter (where message_type = 'KAKAO'), cast(15 as decimal(18,2))) as kakao_price, coalesce(max(unit_price) filter (where message_type = 'SMS'), cast(20 as decimal(18,2))) as sms_price, coalesce(max(unit_price) filter (where message_type = 'LMS'), cast(50 as decimal(18,2))) as lms_price from prices", money=('kakao_price', 'sms_price', 'lms_price'))
def a6_price_pivot(spark, sf_dir):
    return costing.price_pivot(frame(spark, sf_dir, "prices"))


_STATE = with_sql("job_events") + """, state as (select job_id, arg_max(status, (event_ts, event_id)) as status, min(event_ts) as created_at, max(event_ts) filter (where status = 'processing') as started_at,
  max(event_ts) filter (where status in ('completed', 'failed')) as completed_at, arg_max(error, (event_ts, event_id)) filter (where error is not null) as error from job_events group by 1)"""


@_query(_STATE + " select * from state")
def a8_fold_job_state(spark, sf_dir):
    return jobs.fold_job_state(frame(spark, sf_dir, "job_events"))


@_query(_STATE + ", g as (select cast(count(*) filter (where status = 'pending') as bigint) as waiting, cast(count(*) filter (where status = 'processing') as bigint) as running, cast(count(*) filter (where status = 'completed') as bigint) as completed, cast(count(*) filter (where status = 'failed') as bigint) as failed from state) select *, waiting + running >= 100 as is_full, greatest(100 - waiting - running, 0) as available from g")
def a7_queue_gauge(spark, sf_dir):
    return jobs.queue_gauge(jobs.fold_job_state(frame(spark, sf_dir, "job_events")))


@_query(with_sql("recipients") + f", {_COUNTS} select * from counts")
def a9_recipient_count(spark, sf_dir):
    return requests.recipient_count(frame(spark, sf_dir, "recipients"))


@_query(with_sql("recipients") + " select request_id, seq, cast(place // 500 as bigint) as batch_index, cast(place % 500 + 1 as bigint) as slot from (select request_id, seq, row_number() over (partition by request_id order by seq) - 1 as place from recipients)")
def w1_assign_batches(spark, sf_dir):
    return batches.assign_batches(frame(spark, sf_dir, "recipients")).select("request_id", "seq", "batch_index", "slot")


@_query(with_sql("recipients") + " select request_id, seq, cast(seq // 500 as bigint) as batch_index, cast(seq % 500 + 1 as bigint) as slot, phone_number from recipients")
def g1_w1_nested_batches(spark, sf_dir):
    """Nested requests exploded with their positions, and batched by arithmetic."""
    r = frame(spark, sf_dir, "recipients")
    nested = r.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", "phone_number"))).alias("recipients")).withColumn("recipients", F.transform("recipients", lambda x: F.struct(x["phone_number"].alias("phone_number"))))
    return batches.assign_batches_nested(requests.explode_recipients(nested)).select("request_id", "seq", "batch_index", "slot", "phone_number")


@_query(with_sql("recipients") + " select request_id, cast(seq // 500 as int) as chunk, cast(count(*) as int) as n, min(seq) as first_seq from recipients group by 1, 2")
def g3_chunk_array(spark, sf_dir):
    nested = frame(spark, sf_dir, "recipients").groupBy("request_id").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    return nested.select("request_id", F.posexplode(batches.chunk_array(F.col("seqs"))).alias("chunk", "part")).select("request_id", "chunk", F.size("part").alias("n"), F.array_min("part").alias("first_seq"))


@_query(_STATE.replace(", state", """, ends as (select job_id, min((event_ts, event_id)) as up, max((event_ts, event_id)) filter (where status in ('completed', 'failed')) as down from job_events group by 1),
deltas as (select job_id, up[1] as event_ts, up[2] as event_id, 1 as delta from ends union all select job_id, down[1], down[2], -1 from ends where down is not null), state""", 1) + ", s as (select *, cast(sum(delta) over (order by event_ts, event_id, delta desc rows unbounded preceding) as bigint) as depth from deltas) select event_ts, event_id, job_id, delta, depth, depth >= 100 as is_full from s")
def w3_queue_depth_series(spark, sf_dir):
    return jobs.queue_depth_series(frame(spark, sf_dir, "job_events"))


@_query(_STATE + f" select job_id, status, coalesce(coalesce(completed_at, timestamp '{AS_OF}') > started_at + interval 5 minutes, false) as timed_out from state")
def t3_job_timeout(spark, sf_dir):
    return jobs.job_timeout(jobs.fold_job_state(frame(spark, sf_dir, "job_events")), F.lit(AS_OF).cast("timestamp_ntz")).select("job_id", "status", "timed_out")


@_query(_STATE + f" select job_id, status, completed_at from state where completed_at is null or completed_at >= timestamp '{AS_OF}' - interval 1 hour")
def p7_expire_completed_jobs(spark, sf_dir):
    return jobs.expire_completed_jobs(jobs.fold_job_state(frame(spark, sf_dir, "job_events")), F.lit(AS_OF).cast("timestamp_ntz")).select("job_id", "status", "completed_at")


@_query(_STATE + ", wanted as (select distinct o_orderkey as job_id from orders) select w.job_id, s.status, case when s.job_id is null then 'JOB_NOT_FOUND' end as lookup_error from wanted w left join state s on w.job_id = s.job_id")
def j7_lookup_jobs(spark, sf_dir):
    wanted = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")).distinct()
    return jobs.lookup_jobs(wanted, jobs.fold_job_state(frame(spark, sf_dir, "job_events"))).select("job_id", "status", "lookup_error")


_RESULTS = _STATE + ", sums as (select job_id, count(*) as events from job_events group by 1)"


@_query(_RESULTS + " select s.job_id, status, created_at, started_at, completed_at, error, case when status = 'completed' then events end as events from state s join sums u on s.job_id = u.job_id")
def p6_project_job_status(spark, sf_dir):
    events = frame(spark, sf_dir, "job_events")
    counted = jobs.fold_job_state(events).join(events.groupBy("job_id").agg(F.count("*").alias("events")), "job_id")
    return jobs.project_job_status(counted, ["events"])


@_query(_RENDERED + " select * from rendered")
def f2_f7_render(spark, sf_dir):
    """plan_campaign's messages: F2 to F5 and F7 for every recipient that has a template."""
    return _planned(spark, sf_dir)["rendered"].select("request_id", "seq", "batch_index", "slot", "receiver", "subject", "emtitle", "message", "failover", "fsubject", "fmessage")


_OUTBOX = _RENDERED.replace("{", "{{").replace("}", "}}") + """, long as (select request_id, batch_index, slot, unnest([{{'p': 'receiver', 'v': receiver}}, {{'p': 'subject', 'v': subject}}, {{'p': 'emtitle', 'v': emtitle}}, {{'p': 'message', 'v': message}}, {{'p': 'fsubject', 'v': fsubject}}, {{'p': 'fmessage', 'v': fmessage}}]) as x from rendered)
select {0}batch_index, slot, x.p || '_' || slot as param, x.v as value from long where x.v is not null union all select {0}batch_index, 0, 'failover', failover from rendered group by request_id, batch_index, failover"""


@_query(_OUTBOX.format("request_id, "))
def g4_outbox_params(spark, sf_dir):
    return _planned(spark, sf_dir)["outbox"]


@_query(_RENDERED + " select request_id, batch_index, cast(sum(4 - 1 + (case when emtitle is null then 0 else 1 end) + (case when fsubject is null then 0 else 2 end)) + 1 as int) as n_params from rendered group by 1, 2")
def g4_outbox_wide(spark, sf_dir):
    """Parameters of each batch, gathered in order, counted."""
    return batches.outbox_wide(_planned(spark, sf_dir)["outbox"]).select("request_id", "batch_index", F.size("params").alias("n_params"))


_BUTTON_SQL = "'{{\"name\":\"' || {n} || '\",\"linkType\":\"WL\",\"linkTypeName\":\"web\",\"linkMo\":\"' || {mo} || '\",\"linkPc\":\"' || {pc} || '\"}}'"


@_query(with_sql("recipients") + ", b as (select request_id, seq, " + _BUTTON_SQL.format(n="'View'", mo="'https://m.example.com/' || var_order", pc="''") + " as one, " + _BUTTON_SQL.format(n="'Own'", mo="'https://m.example.com/own'", pc="'https://example.com/' || name") + " as own from recipients) select request_id, seq, '{\"button\":[' || case when seq % 3 = 0 then own else one end || ']}' as button from b")
def f6_render_buttons(spark, sf_dir):
    """Template button for all, own button for every third recipient; variables in the web links."""
    def button(name, mo, pc):
        return F.array(F.struct(F.lit(1).alias("ordering"), F.lit(name).alias("name"), F.lit("WL").alias("linkType"), F.lit("web").alias("linkTypeName"), F.lit(mo).alias("linkMo"), F.lit(pc).cast("string").alias("linkPc"), F.lit("app://x").alias("linkIos"), F.lit("app://y").alias("linkAnd")))

    own = F.when(F.col("seq") % 3 == 0, button("Own", "https://m.example.com/own", "https://example.com/#{name}"))
    rows = frame(spark, sf_dir, "recipients")
    return rows.select("request_id", "seq", rendering.render_buttons(own, button("View", "https://m.example.com/#{order}", None), _entries()).alias("button"))


@_query(_SETTLED + ", p as (select coalesce(max(unit_price) filter (where message_type = 'KAKAO'), 15) as k, coalesce(max(unit_price) filter (where message_type = 'SMS'), 20) as s from prices) select request_id, cast(success_count * 9 + sms_count * 20 as decimal(18,2)) as flat, cast(success_count * k + sms_count * s as decimal(18,2)) as priced from settled, p", money=('flat', 'priced'))
def f8_f9_j8_costs(spark, sf_dir):
    settled = _settled(spark, sf_dir, priced=True)["settled"]
    return settled.select("request_id", fn.flat_cost(F.col("success_count"), F.col("sms_count")).alias("flat"), F.col("total_cost").alias("priced"))


@_query(_SETTLED + " select request_id, success, recipient_count, success_count, sms_count, fail_count, cast(success_count * 9 + sms_count * 20 as decimal(18,2)) as total_cost, batch_count from settled", money=('total_cost',))
def p8_send_summary(spark, sf_dir):
    return delivery.project_send_summary(_settled(spark, sf_dir)["settled"])


_PRICES = "p as (select coalesce(max(unit_price) filter (where message_type = 'KAKAO'), 15) as k, coalesce(max(unit_price) filter (where message_type = 'SMS'), 20) as s from prices)"
_LEDGER = _SETTLED + f""", {_PRICES}, results as (select request_id, string_agg(batch_index || ':' || success || ':' || success_count || ':' || fail_count, ',' order by batch_index) as batch_results from known group by 1),
ledger as (select s.*, b.batch_results, k, p.s, timestamp '{AS_OF}' as sent_at from settled s left join results b on s.request_id = b.request_id, p)"""


@_query(_LEDGER + " select request_id, union_id, sender_alias, channel_name, template_code, coalesce(nullif(template_name, ''), template_code) as template_name, coalesce(nullif(template_name, ''), template_code) as title, template_content as content, sender_id, notice_id, recipient_count, success_count, sms_count, fail_count, cast(success_count * k + sms_count * ledger.s as decimal(18,2)) as total_cost, actual_cost, success, coalesce(batch_results, '') as batch_results, cast(sent_at as timestamp) as sent_at, cast(sent_at as date) as sent_date from ledger", money=('total_cost', 'actual_cost'))
def p9_ledger_rows(spark, sf_dir):
    """The whole ledger row; batch results shown as text."""
    return shown_ledger(_settled(spark, sf_dir, priced=True)["ledger"])


def shown_ledger(rows: DataFrame) -> DataFrame:
    each = F.transform("batch_results", lambda b: F.concat_ws(":", b["batch_index"].cast("string"), b["success"].cast("string"), b["success_count"].cast("string"), b["fail_count"].cast("string")))
    return rows.withColumn("batch_results", F.array_join(each, ","))


@_query(with_sql("recipients") + ", k as (select request_id, seq, sha256(request_id || chr(31) || seq) as job_id from recipients) select * from k")
def f11_job_id(spark, sf_dir):
    return frame(spark, sf_dir, "recipients").select("request_id", "seq", fn.job_id(F.col("request_id"), F.col("seq")).alias("job_id"))


def _lines(spark, sf_dir) -> DataFrame:
    return _shown_lines(frame(spark, sf_dir, "access_log"))


def _shown_lines(calls: DataFrame) -> DataFrame:
    level = F.when(F.col("status") >= 400, "ERROR").otherwise("INFO")
    return calls.select(F.format_string("[%s] [%s] %s %s - %d (%dms)", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, "method", "path", "status", "duration_ms").alias("value"))


@_query(with_sql("access_log") + " select date_trunc('second', ts) as ts, case when status >= 400 then 'ERROR' else 'INFO' end as level, method, path, status, duration_ms from access_log")
def f12_parse_access_log(spark, sf_dir):
    """Lines written from events and parsed back."""
    return access_log.parse_access_log(_lines(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_query(with_sql("access_log") + " select method, path, count(*) as calls, count(*) filter (where status >= 400) as errors, cast(sum(duration_ms) as bigint) as duration_ms from access_log group by 1, 2")
def l1_access_log_levels(spark, sf_dir):
    return plans.access_report(_lines(spark, sf_dir))


@_query(_OUTBOX.format("request_id, ") .replace("select request_id, batch_index, slot, x.p || '_' || slot as param, x.v as value", "select request_id, batch_index, slot, x.p || '_' || slot as param, replace(replace(replace(url_encode(x.v), '%20', '+'), '%2A', '*'), '~', '%7E') as value"))
def f13_encode_form(spark, sf_dir):
    """The outbox, form-encoded. DuckDB encodes a blank, a star and a tilde differently, which its SQL puts right."""
    return _planned(spark, sf_dir)["outbox"].withColumn("value", fn.encode_form(F.col("value")))
