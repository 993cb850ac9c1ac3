"""Starting standing queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

# Fixed value: how often the feed is polled.
POLL_INTERVAL = "30 seconds"


def start(
    rows: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
    every: str | None = POLL_INTERVAL,
) -> StreamingQuery:
    """Run ``apply`` on each micro-batch; with ``every=None`` take what is there now and stop.

    A micro-batch that fails is replayed under the same id after a restart, so ``apply`` must be idempotent by id.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        rows.writeStream.outputMode(output_mode)
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def start_publishing(messages: DataFrame, format: str, checkpoint: str, every: str | None = POLL_INTERVAL, **options):
    """Append keyed messages to a log (Kafka or files) as they come."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        messages.writeStream.format(format)
        .outputMode("append")
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def drain(query: StreamingQuery) -> None:
    """Wait for an ``every=None`` query to end; raises what it raised."""
    query.awaitTermination()
