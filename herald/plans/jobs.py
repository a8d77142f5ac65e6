"""The end-to-end jobs: what a user of the library calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herald.operators import access_log, batches, catalog, costing, delivery, jobs, ledger, rendering, requests, resolve

TEMPLATE_COLUMNS = ("template_name", "template_content", "template_em_type", "template_title", "template_subtitle", "template_buttons", "use_failover")


def resolved_requests(reqs: DataFrame, counts: DataFrame, templates: DataFrame, aliases: DataFrame, channels: DataFrame) -> DataFrame:
    """Accepted requests with their template, sender and channel."""
    counted = reqs.join(counts, "request_id", "left").withColumn("recipient_count", F.coalesce("recipient_count", F.lit(0).cast("bigint")))
    accepted = requests.validate_requests(counted).where("reject_code is null").drop("reject_code")
    return resolve.resolve_channel(resolve.resolve_sender_alias(resolve.resolve_template(accepted, templates), aliases), channels)


def plan_campaign(reqs: DataFrame, recipients: DataFrame, templates: DataFrame, aliases: DataFrame, channels: DataFrame, entries: Column) -> dict[str, DataFrame]:
    """``requests`` (resolved), ``rendered`` (one row per recipient), ``outbox`` (long form) and ``rejects``.

    Recipients are partitioned by request and range of position; the small request side is joined by Catalyst's choice.
    """
    resolved = resolved_requests(reqs, requests.recipient_count(recipients), templates, aliases, channels)
    sendable, rejects = requests.split_null_phones(requests.with_phones(recipients))
    batched = batches.assign_batches(sendable)
    found = resolved.where("template_found").select("request_id", *[c for c in TEMPLATE_COLUMNS if c in resolved.columns])
    joined = batched.join(found, "request_id")
    flags = batches.batch_failover_flag(joined)
    rendered = rendering.render(joined, flags, entries)
    return {"requests": resolved, "rendered": rendered, "outbox": batches.outbox_params(rendered, flags), "rejects": rejects}


def settle_campaign(resolved: DataFrame, batch_sizes: DataFrame, responses: DataFrame, sent_at: Column, prices: DataFrame | None = None) -> dict[str, DataFrame]:
    """``outcomes`` (per batch), ``settled`` (per request, with cost), ``ledger`` (as write_send_ledger takes it). Without
    prices, flat rates hold."""
    known = batch_sizes.join(resolved.where("template_found").select("request_id"), "request_id", "left_semi")
    outcomes = delivery.batch_outcome(delivery.reconcile_batches(known, responses))
    rolled = delivery.rollup_requests(resolved, outcomes)
    settled = costing.with_flat_cost(rolled) if prices is None else costing.with_priced_cost(resolve.attach_prices(rolled, costing.price_pivot(prices)))
    return {"outcomes": outcomes, "settled": settled, "ledger": ledger.build_ledger_row(settled, delivery.collect_batch_results(outcomes), sent_at)}


def settled_ledger(rolled: DataFrame, sent_at: Column, prices: DataFrame | None = None) -> DataFrame:
    """Ledger rows of resolved requests that stand beside the sums and results of their batches."""
    sums = ("batch_count", "_all", "success_count", "sms_count", "fail_count", "actual_cost", "batch_results")
    known = rolled.withColumnRenamed("all_ok", "_all")
    settled = delivery.rolled_up(known, [c for c in known.columns if c not in sums], "batch_results")
    costed = costing.with_flat_cost(settled) if prices is None else costing.with_priced_cost(resolve.attach_prices(settled, costing.price_pivot(prices)))
    return ledger.build_ledger_row(costed.drop("batch_results"), costed.select("request_id", "batch_results"), sent_at)


def sync_templates(source: DataFrame, target: DataFrame, updatable: list[str] = catalog.UPDATED, always: tuple[str, ...] = catalog.ALWAYS, synced_at: Column | None = None) -> dict[str, DataFrame]:
    """``merged`` (with the action of each code), ``counts`` and ``rejects`` (listed rows without a code). Every field of
    the listing is written unless fewer are named; ``synced_at`` is the time of the sync."""
    catalog.check_unique(target)
    coded = source.where("template_code is not null")
    merged = catalog.merge_template_catalog(coded, target, updatable, always, synced_at)
    return {"merged": merged, "counts": catalog.merge_counts(coded, merged), "rejects": source.where("template_code is null")}


def job_report(events: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """``state`` (folded, time-outs marked, old ones gone), ``gauge`` and ``depth``."""
    state = jobs.job_timeout(jobs.fold_job_state(events), as_of)
    return {"state": jobs.expire_completed_jobs(state, as_of), "gauge": jobs.queue_gauge(state), "depth": jobs.queue_depth_series(events)}


def access_report(lines: DataFrame) -> DataFrame:
    return access_log.access_log_levels(access_log.parse_access_log(lines))
