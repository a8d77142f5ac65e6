"""The entities of the notification jobs, derived by SQL from the star-schema tables (see FIXTURES.md).

One text serves Spark and the SQL oracle. ``frame`` derives one as a DataFrame, ``with_sql`` as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "requests": """
        select cast(n_nationkey as bigint) as request_id, case when n_nationkey = 13 then '' else cast(n_nationkey as string) end as union_id,
          case when n_nationkey % 10 = 9 then 'Brand#99' else 'Brand#' || cast(n_nationkey + 1 as string) end as template_code,
          'sender-' || n_name as sender_id, case when n_nationkey % 4 <> 0 then 'notice-' || cast(n_regionkey as string) end as notice_id from nation""",
    "recipients": """
        select cast(c_nationkey as bigint) as request_id, cast(row_number() over (partition by c_nationkey order by o_orderkey) - 1 as bigint) as seq,
          case when o_orderkey % 211 = 0 then null else case o_custkey % 6
            when 0 then '010-' || substr(lpad(cast(o_custkey as string), 8, '0'), 1, 4) || '-' || substr(lpad(cast(o_custkey as string), 8, '0'), 5, 4)
            when 1 then '+82 10-' || lpad(cast(o_custkey as string), 8, '0')
            when 2 then '8210' || lpad(cast(o_custkey as string), 8, '0')
            when 3 then '+82 010-' || lpad(cast(o_custkey as string), 8, '0')
            when 4 then '02-' || lpad(cast(o_custkey as string), 7, '0')
            else '011' || lpad(cast(o_custkey as string), 7, '0') end end as phone_number,
          c_name as name, cast(o_orderkey as string) as var_order, cast(cast(o_totalprice as decimal(18,2)) as string) as var_amount,
          case when o_orderpriority = '1-URGENT' then '[urgent] #{name} #{order}' when o_orderkey % 41 = 0 then '' end as content,
          case when o_orderkey % 97 = 0 then 'Notice for #{name}' end as failover_subject,
          case when o_orderkey % 97 = 0 or o_orderkey % 499 = 0 then 'Order #{order}: #{amount}' end as failover_message
        from orders join customer on o_custkey = c_custkey""",
    "template_target": """
        select distinct p_brand as template_code, 'Template ' || p_brand as template_name,
          case when p_brand = 'Brand#7' then '' else 'Hello #{name}, order #{order} total #{amount} #{missing}' end as template_content,
          case when cast(substr(p_brand, 7) as int) % 3 = 0 then 'TEXT' else 'NONE' end as template_em_type,
          case when cast(substr(p_brand, 7) as int) % 6 = 0 then 'For #{name}' end as template_title,
          'sub ' || p_brand as template_subtitle, cast(substr(p_brand, 7) as int) % 4 = 0 as use_failover from part where cast(substr(p_brand, 7) as int) <= 20""",
    "template_source": """
        select b.code as template_code, b.pos as pos, 'Template ' || b.code || case when b.pos >= 100 then ' v2' else '' end as template_name,
          case when b.pos % 2 = 0 then 'new #{name}' end as template_content from (
            select p_brand as code, cast(substr(p_brand, 7) as int) as pos from part where cast(substr(p_brand, 7) as int) >= 6 group by p_brand
            union all select p_brand, 100 + cast(substr(p_brand, 7) as int) from part where cast(substr(p_brand, 7) as int) % 7 = 0 group by p_brand) b""",
    "key_aliases": """
        select 'union_' || cast(n_nationkey as string) || '_sender_key' as name, 'alias-' || cast(n_nationkey as string) as key_alias from nation where n_nationkey % 3 <> 0
        union all select 'union_4_sender_key', 'alias-4-dup' from nation where n_nationkey = 4""",
    "channels": "select cast(n_nationkey as string) as id, case n_nationkey % 5 when 0 then null when 1 then '' else n_name end as kakao_channel_id from nation",
    "batches": "select request_id, cast(floor(seq / 500) as bigint) as batch_index, cast(count(*) as bigint) as batch_size from recipients group by 1, 2",
    "responses": """
        select request_id, batch_index, case when (request_id * 31 + batch_index) % 11 = 0 then -99 else 0 end as code,
          cast(batch_size - floor(batch_size / 10) as bigint) as scnt, cast(floor(batch_size / 10) as bigint) as fcnt, cast((batch_size - floor(batch_size / 10)) * 9 as bigint) as total
        from batches where (request_id * 31 + batch_index) % 13 <> 0""",
    "prices": """
        select 'KAKAO' as message_type, cast(7 + count(*) % 29 as decimal(18,2)) as unit_price from orders
        union all select 'SMS', cast(null as decimal(18,2)) from region where r_regionkey = 0
        union all select 'FAX', cast(count(*) as decimal(18,2)) from part""",
    "listed_dates": """
        select pos, template_code, case when pos % 7 = 0 then null when pos % 5 = 0 then 'on day ' || cast(pos as string)
          else '2024-02-' || lpad(cast(1 + pos % 28 as string), 2, '0') || case when pos % 3 = 1 then 'T04:05:06Z' else ' 04:05:06' end end as cdate from template_source""",
    "listed_templates": """
        select s.template_code, s.pos, cast(floor(s.pos / 5) as bigint) as page, s.template_name, s.template_content, d.cdate, case s.pos % 3 when 0 then 'A' when 1 then 'S' else 'R' end as status,
          case when s.pos % 4 = 0 then 'REJ' else 'APR' end as insp_status, 'key-' || cast(s.pos % 4 as string) as sender_key, case when s.pos % 2 = 0 then 'BA' else 'EX' end as template_type,
          case when s.pos % 3 = 0 then 'TEXT' else 'NONE' end as template_em_type, case when s.pos % 3 = 2 then 'title ' || cast(s.pos as string) end as template_title,
          case when (s.pos + 1) % 3 = 2 then 'subtitle ' || cast(s.pos as string) end as template_subtitle, case when (s.pos + 2) % 3 = 2 then cast(s.pos as string) || '.png' end as template_image_name,
          case when s.pos % 3 = 2 then 'https://example.com/' || cast(s.pos as string) end as template_image_url, case when (s.pos + 1) % 3 = 2 then 'comment ' || cast(s.pos as string) end as comments
        from template_source s join listed_dates d on s.template_code = d.template_code and s.pos = d.pos""",
    "stored_templates": """
        select t.*, 'A' as status, 'REQ' as insp_status, 'old-key' as sender_key, 'BA' as template_type, 'old.png' as template_image_name, 'https://example.com/old' as template_image_url,
          timestamp '2020-01-01 00:00:00' as cdate, 'old comment' as comments, timestamp '2020-01-01 00:00:00' as synced_at from template_target t""",
    "job_events": """
        select cast(floor(event_id / 5) as bigint) as job_id, event_id, ts as event_ts,
          case event_type when 'signup' then 'pending' when 'view' then 'pending' when 'click' then 'processing' when 'purchase' then 'completed' else 'failed' end as status,
          case when event_type = 'error' then 'E' || cast(event_id % 3 as string) end as error from events""",
    "access_log": """
        select event_id, ts, 'POST' as method, case event_type when 'view' then '/health' else '/api/send' end as path,
          case event_type when 'error' then 500 when 'signup' then 202 else 200 end as status, cast(event_id % 900 as int) as duration_ms from events""",
}

_NAMES = "|".join([*TABLES, *SQL])
_FROM = re.compile(rf"\b(from|join)\s+({_NAMES})\b")


def needs(name: str) -> list[str]:
    """The fixtures that a fixture is derived from, first ones first, itself last."""
    out: list[str] = []
    for _, other in _FROM.findall(SQL[name]):
        if other in SQL:
            out += [x for x in needs(other) if x not in out]
    return [*out, name]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name]
    inputs = {other: frame(spark, sf_dir, other) for _, other in _FROM.findall(text)}
    return spark.sql(_FROM.sub(r"\1 {\2}", text.replace("{", "{{").replace("}", "}}")), **inputs)


def with_sql(*names: str) -> str:
    """``with a as (...), b as (...)`` for these fixtures and what they need."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in needs(n) if x not in wanted]
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in wanted)
