"""Running streams: a function per micro-batch, draining, and resuming."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
          every: str | None = None) -> StreamingQuery:
    """Run ``handle(rows, delta_id)`` on every micro-batch.

    Without ``every`` the query takes what is there now and ends; with it ('1 second') it goes on until stopped. The
    checkpoint holds how far the source was read: a batch that failed is handed over again with the same id, so a
    handler that writes under its id delivers exactly once.
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def drain(query: StreamingQuery) -> None:
    """Let a running query finish the input that is there, then stop it."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination()
