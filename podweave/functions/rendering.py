"""Text form of an event."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from podweave.functions.timestamps import format_time_of_day


def is_stderr(stream: Column) -> Column:
    return stream == F.lit("stderr")


def stream_label(flag: Column) -> Column:
    return F.when(flag, "stderr").otherwise("stdout")


def render_line(stderr: Column, stream_id: Column, timestamp_ns: Column, payload: Column) -> Column:
    """``[stdout] StreamID: 7 | Time: 20:13:09.123456 | Msg: hello``; the payload's bytes pass through unchanged."""
    return F.concat(
        F.lit("["), stream_label(stderr), F.lit("] StreamID: "), stream_id.cast("string"),
        F.lit(" | Time: "), format_time_of_day(timestamp_ns), F.lit(" | Msg: "), payload.cast("string"),
    )
