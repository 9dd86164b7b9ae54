"""Lines to events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podweave.functions.bytes import trim_eol, trim_escaped_eol
from podweave.functions.lines import FORMATS, STREAMS, detect_format
from podweave.functions.timestamps import rfc3339_to_ns

PARSED = ("timestamp_ns", "stream", "is_partial", "payload")


def _staged(lines: DataFrame, line: str, formats) -> tuple[DataFrame, Column]:
    """The lines with their raw parts, and the parsed record: an array of one struct, or null on a malformed line.

    Each format sees null for the lines of the others, so that its expressions need no CASE around them: Spark computes
    a shared part once only outside of conditions.
    """
    staged = lines.withColumn("format", detect_format(F.col(line), formats))
    staged = staged.withColumns({f"_line_{f.name}": F.when(F.col("format") == f.name, F.col(line)) for f in formats})
    staged = staged.withColumns({f"_view_{f.name}": f.view(F.col(f"_line_{f.name}")) for f in formats})
    staged = staged.withColumns({f"_raw_{f.name}": f.fields(F.col(f"_view_{f.name}")) for f in formats})

    def raw(field: str) -> Column:
        return F.coalesce(*(F.col(f"_raw_{f.name}.{field}") for f in formats))

    staged = staged.withColumns({"_time": raw("time"), "_stream": raw("stream"), "_payload": trim_eol(raw("payload"))})
    staged = staged.withColumn("_ns", rfc3339_to_ns(F.col("_time")))
    payload = F.col("_payload")
    for f in formats:
        if f.escaped:
            payload = F.when(F.col("format") == f.name, trim_escaped_eol(F.col("_payload"))).otherwise(payload)
    record = F.struct(
        F.col("_ns").alias("timestamp_ns"),
        F.col("_stream").alias("stream"),
        raw("is_partial").alias("is_partial"),
        payload.alias("payload"),
    )
    complete = F.col("_ns").isNotNull() & F.col("_stream").isin(*STREAMS) & F.col("_payload").isNotNull()
    return staged, F.when(complete, F.array(record))


def parse_all(lines: DataFrame, line: str = "line", formats=FORMATS) -> DataFrame:
    """Add ``format, timestamp_ns, stream, is_partial, payload``; all but the format are null on a malformed line."""
    staged, record = _staged(lines, line, formats)
    return staged.select(*lines.columns, "format", F.inline_outer(record))


def parse_lines(lines: DataFrame, line: str = "line", formats=FORMATS) -> DataFrame:
    """Events of the lines that parse; the others are dropped.

    A line is a table function of no or one row here. A filter on the parsed columns would be pushed below the
    projection by the optimizer and parse every line twice.
    """
    staged, record = _staged(lines, line, formats)
    return staged.select(*lines.columns, "format", F.inline(record))


def malformed_lines(lines: DataFrame, line: str = "line", formats=FORMATS) -> DataFrame:
    """The lines that ``parse_lines`` drops."""
    return parse_all(lines, line, formats).where(F.col("timestamp_ns").isNull()).drop(*PARSED)
