"""Log line formats. A format says which lines are its own and takes the raw fields out of them.

``fields(line)`` gives ``struct<time STRING, stream STRING, is_partial BOOLEAN, payload BINARY>`` with nulls where the
line does not fit, and with all fields null for a null line. A user's own format is one more ``LineFormat`` in the list
given to ``parse_lines``.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from podweave.functions.bytes import ONE_BYTE_CHARSET

STREAMS = ("stdout", "stderr")


@dataclass(frozen=True)
class LineFormat:
    name: str
    matches: Callable[[Column], Column]
    fields: Callable[[Column], Column]
    view: Callable[[Column], Column] = lambda line: line  # a form of the line computed once, for fields() to read
    escaped: bool = False  # the payload's line end is written out as backslash and letter


def json_string_field(text: Column, key: str) -> Column:
    """Raw text (escapes kept) of the first quoted value behind the first ``"key"``; null when there is none.

    The pattern never backtracks, so the length of a line does not matter.
    """
    value = rf'(?s)"{key}"[^:]*+:[^"]*+"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
    return F.try_element_at(F.regexp_extract_all(text, F.lit(value), 1), F.lit(1))


def json_view(line: Column) -> Column:
    """Text for the patterns: the line, or one character per byte where it is not UTF-8; and which of both it is."""
    valid = F.is_valid_utf8(line)
    text = F.when(valid, line).otherwise(F.decode(line.cast("binary"), ONE_BYTE_CHARSET))
    return F.struct(text.alias("text"), valid.alias("valid"))


def json_fields(view: Column) -> Column:
    text = view["text"]
    log = json_string_field(text, "log")
    return F.struct(
        json_string_field(text, "time").alias("time"),
        json_string_field(text, "stream").alias("stream"),
        F.when(text.isNotNull(), False).alias("is_partial"),
        F.when(view["valid"], log.cast("binary")).otherwise(F.encode(log, ONE_BYTE_CHARSET)).alias("payload"),
    )


def cri_fields(line: Column) -> Column:
    time = F.substring_index(line, " ", 1)
    before = F.octet_length(time)
    data = line.cast("binary")
    # Behind the time: one space, six bytes of stream name, one space, one tag byte, one byte of any kind, payload.
    mark = F.substring(data, before + 2, F.lit(8))
    known = mark.isin(b"stdout F", b"stdout P", b"stderr F", b"stderr P") & (F.octet_length(data) >= before + 10)
    return F.struct(
        time.alias("time"),
        F.when(known, F.substring(mark, 1, 6).cast("string")).alias("stream"),
        (F.substring(mark, 8, 1) == F.lit(b"P")).alias("is_partial"),
        F.when(known, F.substring(data, before + 11, F.lit(2_000_000_000))).alias("payload"),
    )


JSON = LineFormat("json", lambda line: line.startswith("{"), json_fields, json_view, escaped=True)
CRI = LineFormat("cri", lambda line: F.lit(True), cri_fields)
# The first format that claims a line keeps it, also when the line then fails.
FORMATS = (JSON, CRI)


def detect_format(line: Column, formats=FORMATS) -> Column:
    case = F.when(formats[0].matches(line), formats[0].name)
    for f in formats[1:]:
        case = case.when(f.matches(line), f.name)
    return case
