"""Settling as a stream: sent batches meet the provider's answers as both arrive, and a request is settled with its last batch."""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from herald.operators import delivery
from herald.plans.jobs import settled_ledger
from herald.sources.writers import write_send_ledger

RESULT = "success boolean, success_count bigint, sms_count bigint, fail_count bigint, actual_cost decimal(18,2), error string"
ROLLED = f"request_id bigint, batch_count bigint, all_ok boolean, success_count bigint, sms_count bigint, fail_count bigint, actual_cost decimal(18,2), batch_results array<struct<batch_index bigint, {RESULT}>>"


def stream_outcomes(batches: DataFrame, answers: DataFrame, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """request_id, batch_index, n_batches and the outcome of every sent batch, once.

    batches: request_id, batch_index, batch_size, n_batches (of its request), sent_ts; answers: request_id, batch_index,
    answered_ts, code, message, info. An answer counts if it came no later than ``wait`` after its batch was sent, by event
    time; a batch without one fails when both streams have moved on by that and ``late``. Its row is held in state till then.
    Of several answers to a batch one counts: others within ``wait`` of it are left out, and later ones are too late.
    """
    sent = batches.withWatermark("sent_ts", late)
    got = answers.select(F.col("request_id").alias("_request"), F.col("batch_index").alias("_batch"), "answered_ts", "code", "message", "info").withWatermark("answered_ts", wait).dropDuplicatesWithinWatermark(["_request", "_batch"])
    same = (F.col("request_id") == F.col("_request")) & (F.col("batch_index") == F.col("_batch"))
    in_time = (F.col("answered_ts") >= F.col("sent_ts")) & (F.col("answered_ts") <= F.col("sent_ts") + F.expr(f"interval {wait}"))
    return delivery.batch_outcome(sent.where("n_batches > 0").join(got, same & in_time, "left"), "n_batches")


class RequestProcessor(StatefulProcessor):
    """Holds the outcomes of a request's batches until all are there, gives one row then, and forgets the request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.results = handle.getMapState("results", "batch_index bigint", RESULT)
        self.known = handle.getValueState("known", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, wanted = (self.known.get()[0] if self.known.exists() else 0), 0
        for batch in rows:
            for r in batch.itertuples(index=False):
                wanted, known = int(r.n_batches), known + 1
                self.results.updateValue((int(r.batch_index),), (bool(r.success), int(r.success_count), int(r.sms_count), int(r.fail_count), r.actual_cost, r.error if isinstance(r.error, str) else None))
        if known < wanted:
            self.known.update((known,))
            return
        yield self._row(key[0])
        self.results.clear()
        self.known.clear()

    def _row(self, request: int) -> pd.DataFrame:
        found = sorted((k[0], *v) for k, v in self.results.iterator())
        sums = [sum(f[k] for f in found) for k in (2, 3, 4)]
        cost = sum((f[5] for f in found), decimal.Decimal(0))
        names = ("batch_index", "success", "success_count", "sms_count", "fail_count", "actual_cost", "error")
        return pd.DataFrame({"request_id": [request], "batch_count": [len(found)], "all_ok": [all(f[1] for f in found)], "success_count": sums[:1], "sms_count": sums[1:2], "fail_count": sums[2:], "actual_cost": [cost], "batch_results": [[dict(zip(names, f)) for f in found]]})

    def close(self) -> None:
        pass


def stream_rollup(outcomes: DataFrame) -> DataFrame:
    """One row (ROLLED) per request, as its last batch has an outcome. The session's state store must be RocksDB.

    The roll-up keeps no time of its own: an outcome that the join gives just as its time runs out is not too late for it."""
    return outcomes.groupBy("request_id").transformWithStateInPandas(RequestProcessor(), ROLLED, "Append", "None")


def stream_settlement(batches: DataFrame, answers: DataFrame, resolved: DataFrame, sent_at: Column, path: str, checkpoint: str, prices: DataFrame | None = None, wait: str = "10 minutes", late: str = "1 minute") -> StreamingQuery:
    """Start settling what is there and stop: rows of finished requests are appended to the ledger at ``path``.

    ``resolved`` has the requests. Those without a template or a recipient to send to have no batch: a row of the batches
    with ``n_batches`` 0 settles one at once. A replayed micro-batch adds nothing, as the ledger is keyed by request.
    """
    rolled = stream_rollup(stream_outcomes(batches, answers, wait, late))
    empty = batches.where("n_batches = 0").select("request_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rolled.schema.fields[1:]])

    def put(batch: DataFrame, _: int) -> None:
        write_send_ledger(settled_ledger(resolved.join(batch, "request_id"), sent_at, prices), path)

    return rolled.union(empty).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
