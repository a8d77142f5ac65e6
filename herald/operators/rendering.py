"""One rendered message per recipient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herald.functions.columns import filled, first_filled, substitute_vars


def variables(*names_and_columns: tuple[str, str]) -> Column:
    """Ordered variables from columns, as an array of (key, value)."""
    return F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in names_and_columns])


def pick_message(content: Column, template_content: Column, title: Column, entries: Column) -> Column:
    return substitute_vars(first_filled(content, template_content, title), entries)


def pick_emphasis(own: Column, em_type: Column, title: Column, subtitle: Column, entries: Column) -> Column:
    """The recipient's emphasis, or the template's title or subtitle if its type is TEXT; absent if empty before variables."""
    return substitute_vars(F.coalesce(filled(own), F.when(em_type == "TEXT", first_filled(title, subtitle))), entries)


def render_buttons(own: Column, template: Column, entries: Column) -> Column:
    """JSON {"button":[...]} of the recipient's buttons, or the template's if there are none; absent without any.

    Variables go into the two web links only; ordering and application links are left out; a missing link is empty.
    """
    def shown(b: Column) -> Column:
        link = lambda c: F.coalesce(substitute_vars(b[c], entries), F.lit(""))
        return F.struct(b["name"].alias("name"), b["linkType"].alias("linkType"), b["linkTypeName"].alias("linkTypeName"), link("linkMo").alias("linkMo"), link("linkPc").alias("linkPc"))

    chosen = F.when(F.size(own) > 0, F.transform(own, shown)).when(F.size(template) > 0, F.transform(template, shown))
    return F.when(chosen.isNotNull(), F.to_json(F.struct(chosen.alias("button"))))


def pick_failover(flag: Column, subject: Column, message: Column, template_flag: Column, template_title: Column, template_name: Column, template_content: Column, entries: Column) -> Column:
    """Struct (fsubject, fmessage) of a batch whose flag is Y: the recipient's pair if whole, else the template's if it
    has failover and content, else null."""
    own = filled(subject).isNotNull() & filled(message).isNotNull()
    theirs = F.coalesce(template_flag, F.lit(False)) & filled(template_content).isNotNull()
    pair = lambda s, m: F.struct(substitute_vars(s, entries).alias("fsubject"), substitute_vars(m, entries).alias("fmessage"))
    return F.when(flag == "Y", F.when(own, pair(subject, message)).when(theirs, pair(first_filled(template_title, template_name), template_content)))


def render(batched: DataFrame, flags: DataFrame, entries: Column) -> DataFrame:
    """Recipients with their template's columns and batch -> receiver, subject, emtitle, message, button, fsubject,
    fmessage, failover."""
    return render_flagged(batched.join(flags, ["request_id", "batch_index"]), entries)


def render_flagged(flagged: DataFrame, entries: Column) -> DataFrame:
    """The same for recipients that carry the flag of their batch."""
    rows = flagged.withColumn("_vars", entries)
    for c, kind in (("emtitle", "string"), ("buttons", "array<struct<name:string,linkType:string,linkTypeName:string,linkMo:string,linkPc:string>>"), ("template_buttons", "array<struct<name:string,linkType:string,linkTypeName:string,linkMo:string,linkPc:string>>")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    v, c = F.col("_vars"), F.col
    return rows.withColumns({
        "subject": c("template_name"),
        "emtitle": pick_emphasis(c("emtitle"), c("template_em_type"), c("template_title"), c("template_subtitle"), v),
        "message": pick_message(c("content"), c("template_content"), c("template_name"), v),
        "button": render_buttons(c("buttons"), c("template_buttons"), v),
        "_pair": pick_failover(c("failover"), c("failover_subject"), c("failover_message"), c("use_failover"), c("template_title"), c("template_name"), c("template_content"), v),
    }).withColumns({"fsubject": c("_pair.fsubject"), "fmessage": c("_pair.fmessage")}).drop("_pair", "_vars")
