"""Events as text lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podweave.functions.rendering import render_line


def render(events: DataFrame) -> DataFrame:
    """One ``line`` per event (``is_stderr, stream_id, timestamp_ns, payload``)."""
    return events.select(
        render_line(F.col("is_stderr"), F.col("stream_id"), F.col("timestamp_ns"), F.col("payload")).alias("line")
    )


def write_text(events: DataFrame, directory: str) -> None:
    render(events).write.mode("append").text(directory, lineSep="\n")


def stream_text(events: DataFrame, directory: str, checkpoint: str):
    """Rendered lines of a stream as text files, each event exactly once; ends when the source is drained."""
    sink = render(events).writeStream.format("text").outputMode("append").option("path", directory)
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
