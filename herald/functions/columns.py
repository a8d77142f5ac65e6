"""Column rules of the notification jobs. All are built-in Spark expressions.

Absent, null and empty text count alike ("falsy") wherever a rule falls back to another value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KAKAO_RATE, SMS_RATE = 9, 20


def filled(c) -> Column:
    """The text, or null where it is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))


def first_filled(*cs) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def normalize_phone(phone: Column) -> Column:
    """ASCII digits only; a leading country code 82 becomes 0. Null stays null."""
    return F.regexp_replace(F.regexp_replace(phone, "[^0-9]", ""), "^82", "0")


def is_valid_phone(phone: Column) -> Column:
    return F.coalesce(normalize_phone(phone).rlike(r"^01[016789][0-9]{7,8}$"), F.lit(False))


def substitute_vars(text: Column, entries: Column) -> Column:
    """Replace every #{key} by its value, entry after entry (array of key, value): later ones see earlier results.

    Keys and values are literal text; a null value is written as ``null``; placeholders without an entry stay.
    """
    step = lambda acc, e: F.replace(acc, F.concat(F.lit("#{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("null")))
    return F.aggregate(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), text, step)


def ordered_variables(json: Column) -> Column:
    """Array of (key, value) of a JSON object's text: whole numbers below 2**32 - 1 first, ascending, then the other keys as
    they stand; a key that stands twice has its first place and its last value; null is null, no object has none."""
    def arranged(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
        number = lambda k: F.when(k.rlike("^(0|[1-9][0-9]{0,9})$") & (k.cast("bigint") < (1 << 32) - 1), k.cast("bigint"))
        place = F.transform(keys, lambda k, i: F.struct(number(k).isNull().alias("later"), F.coalesce(number(k), i.cast("bigint")).alias("at"), k.alias("key"), last(k).alias("value")))
        return F.transform(F.array_sort(place), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))

    return F.get(F.transform(F.array(F.map_entries(F.from_json(json, "map<string,string>"))), arranged), F.lit(0))


def flat_cost(kakao: Column, sms: Column, kakao_rate=KAKAO_RATE, sms_rate=SMS_RATE) -> Column:
    """Cost at fixed rates (the queued path)."""
    return (kakao * kakao_rate + sms * sms_rate).cast("decimal(18,2)")


def priced_cost(kakao: Column, sms: Column, kakao_price: Column, sms_price: Column) -> Column:
    """Cost at listed prices (the synchronous path); the LMS price takes no part."""
    return (kakao * kakao_price + sms * sms_price).cast("decimal(18,2)")


def parse_cdate(text: Column) -> Column:
    """Creation date of a template, or null: absent, empty or malformed (rows of the last kind go to the rejects).

    ISO dates and times are taken, with a space or a T between, seconds, their fraction and a zone or none (the session's)."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?)?$"), F.try_to_timestamp(bare))


def job_id(*ingest_key: Column) -> Column:
    """An id from the place a request was read from, so a replay gets the same one and two equal requests differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in ingest_key]), 256)


def encode_form(value: Column) -> Column:
    return F.url_encode(value)


def count_or_zero(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))


def key_name(union_id: Column) -> Column:
    return F.concat(F.lit("union_"), union_id, F.lit("_sender_key"))


ACCESS_LINE = r"^\[([^\]]+)\] \[([A-Z]+)\] ([A-Z]+) (\S+) - ([0-9]{3}) \(([0-9]+)ms\)$"


ACCESS_START = r"^\[[^\]]+\] [A-Z]+ \S+$"


def access_line_kind(line: Column) -> Column:
    """``finish`` (a call's end, with its status and duration), ``start`` (its begin) or ``other``; null counts as other."""
    return F.when(line.rlike(ACCESS_LINE), "finish").when(line.rlike(ACCESS_START), "start").otherwise("other")


def parse_access_line(line: Column) -> Column:
    """Struct of ts, level, method, path, status, duration_ms; null for another kind of line."""
    part = lambda k: F.regexp_extract(line, ACCESS_LINE, k)
    status = part(5).cast("int")
    fields = F.struct(
        F.try_to_timestamp(part(1)).alias("ts"), F.when(status >= 400, "ERROR").otherwise("INFO").alias("level"), part(3).alias("method"),
        part(4).alias("path"), status.alias("status"), part(6).cast("int").alias("duration_ms"),
    )
    return F.when(line.rlike(ACCESS_LINE), fields)
