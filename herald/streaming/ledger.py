"""The ledger as a streaming sink: one row per finished request, whatever is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from herald.sources.writers import write_send_ledger


def stream_ledger(rows: DataFrame, path: str, checkpoint: str, key: str = "request_id", recipients: DataFrame | None = None) -> StreamingQuery:
    """Append what is there and stop; a key that its dates of the ledger hold is not written again. The recipients of a
    micro-batch's requests, out of a table of recipients, go with it under one commit."""
    return rows.writeStream.foreachBatch(lambda batch, _: write_send_ledger(batch, path, recipients, key=key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
