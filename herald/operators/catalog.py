"""The template catalogue: the provider's listing merged into the stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herald.functions.columns import filled, parse_cdate

BUTTON = "struct<ordering:int,name:string,linkType:string,linkTypeName:string,linkMo:string,linkPc:string,linkIos:string,linkAnd:string>"
#: Provider field -> stored column. Fixed values.
FIELDS = {
    "templtCode": "template_code", "templtName": "template_name", "templtContent": "template_content", "status": "status", "inspStatus": "insp_status", "senderKey": "sender_key", "buttons": "buttons",
    "templateType": "template_type", "templateEmType": "template_em_type", "templtTitle": "template_title", "templtSubtitle": "template_subtitle", "templtImageName": "template_image_name",
    "templtImageUrl": "template_image_url", "cdate": "cdate", "comments": "comments",
}
LISTED = ", ".join(f"{f} array<{BUTTON}>" if f == "buttons" else f"{f} string" for f in FIELDS)
#: What a sync writes, besides the code and the time of the sync; of these ``cdate`` is written even where it is absent.
UPDATED = [c for c in FIELDS.values() if c != "template_code"]
ALWAYS = ("cdate",)


def unwrap_success_envelope(envelopes: DataFrame) -> DataFrame:
    """Envelopes with code 0 and a list."""
    return envelopes.where((F.col("code") == 0) & F.col("list").isNotNull())


def explode_templates(envelopes: DataFrame) -> DataFrame:
    """One row per listed template: ``page`` (0 where the envelopes have none), its position ``pos``, the provider's fields,
    and ``present``: the names of the fields that the listing has, if only as null. ``list`` holds objects as JSON text."""
    page = F.coalesce("page", F.lit(0).cast("bigint")) if "page" in envelopes.columns else F.lit(0).cast("bigint")
    each = envelopes.select(page.alias("page"), F.posexplode("list").alias("pos", "raw"))
    return each.select("page", "pos", F.from_json("raw", LISTED).alias("t"), F.json_object_keys("raw").alias("present")).select("page", "pos", "t.*", "present")


def map_provider_template(listed: DataFrame) -> DataFrame:
    """Provider names to stored names, in the columns and in ``present``; fields that are not stored are left out."""
    names = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    present = F.filter(F.transform("present", lambda k: F.element_at(names, k)), lambda c: c.isNotNull())
    return listed.select(*[c for c in ("page", "pos") if c in listed.columns], *[F.col(f).alias(c) for f, c in FIELDS.items()], present.alias("present"))


def split_bad_dates(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates with ``cdate`` as a timestamp (an empty one is absent), and those whose date is malformed."""
    parsed = templates.withColumn("_cdate", parse_cdate(F.col("cdate")))
    good = filled("cdate").isNull() | F.col("_cdate").isNotNull()
    return parsed.where(good).withColumn("cdate", F.col("_cdate")).drop("_cdate"), parsed.where(~good).drop("_cdate").withColumn("reject_code", F.lit("BAD_CDATE"))


def last_source_row(source: DataFrame) -> DataFrame:
    """Of rows with one code the one listed last: by page, if there are pages, and position."""
    last = [F.col(c).desc() for c in ("page", "pos") if c in source.columns]
    return source.withColumn("_n", F.row_number().over(W.partitionBy("template_code").orderBy(*last))).where("_n = 1").drop("_n")


def check_unique(target: DataFrame, key: str = "template_code") -> None:
    """A stored catalogue with a code twice is an error, not something to merge into."""
    if not (twice := target.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(5)).isEmpty():
        raise ValueError(f"stored templates have these codes more than once: {[r[0] for r in twice.collect()]}")


def merge_template_catalog(source: DataFrame, target: DataFrame, updatable: list[str], always: tuple[str, ...] = (), synced_at: Column | None = None) -> DataFrame:
    """template_code, action (insert, update, delete, keep) and the merged columns, of both sides' codes.

    A field has three states where the source has ``present``: absent keeps the stored value, null clears it, a value
    replaces it; without ``present`` a null counts as absent. Fields in ``always`` are written whatever their state, and
    ``synced_at``, if given, in every listed row. Stored columns that the source never has (the failover flag) are
    carried; a stored row without a code is kept; an empty source changes nothing. The columns are the target's, and
    those of the updatable ones that it lacks.
    """
    s, t = last_source_row(source).alias("s"), target.alias("t")
    some = not source.isEmpty()
    joined = s.join(t, F.col("s.template_code") == F.col("t.template_code"), "full_outer")
    in_s, in_t = F.col("s.template_code").isNotNull(), F.col("t.template_code").isNotNull()
    action = F.when(in_s & in_t, "update").when(in_s, "insert").when(in_t & F.lit(some), "delete").otherwise("keep")
    new = [c for c in updatable if c in source.columns]

    def merged(c: str) -> Column:
        listed = F.col(f"s.{c}") if c in new else None
        stored = F.col(f"t.{c}") if c in target.columns else F.lit(None)
        if c == "synced_at" and synced_at is not None:
            return F.when(in_s, synced_at).otherwise(stored)
        if listed is None:
            return F.coalesce(stored, F.lit(False)) if c == "use_failover" else stored
        if c in always:
            return F.when(in_s, listed).otherwise(stored)
        if "present" in source.columns:
            return F.when(in_s & F.array_contains("s.present", c), listed).otherwise(stored)
        return F.coalesce(listed, stored)

    columns = list(dict.fromkeys([*target.columns, *new, *(["synced_at"] if synced_at is not None else [])]))
    return joined.select(F.coalesce("s.template_code", "t.template_code").alias("template_code"), action.alias("action"), *[merged(c).alias(c) for c in columns if c != "template_code"])


def stale_templates(target: DataFrame, source: DataFrame) -> DataFrame:
    """Stored rows whose code is not listed; rows without a code are not stale; nothing is if nothing is listed."""
    if source.isEmpty():
        return target.limit(0)
    return target.where("template_code is not null").join(source.select("template_code").where("template_code is not null").distinct(), "template_code", "left_anti")


def merge_counts(source: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: inserted (codes new to the catalogue), updated (the listing's other rows, repeats included), deleted, total."""
    made = merged.agg(F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "delete").alias("deleted"))
    return made.crossJoin(source.agg(F.count("*").alias("total"))).select("inserted", (F.col("total") - F.col("inserted")).alias("updated"), "deleted", "total")
