"""Byte-exact helpers. Payloads are BINARY; text is only a view of them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# One byte becomes one character and back, whatever the byte is.
ONE_BYTE_CHARSET = "ISO-8859-1"
CR, LF = b"\r", b"\n"


def div(a: Column, b) -> Column:
    """Integral division, truncating like SQL's DIV."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def floor_div(a: Column, b: int) -> Column:
    """Integral division rounding down, also for negative numbers."""
    return div(a - F.pmod(a, F.lit(b)), b)


def payload_bytes(payload: Column) -> Column:
    """Length in bytes, not characters."""
    return F.octet_length(payload).cast("bigint")


def tail(data: Column, n: int) -> Column:
    """The last n bytes."""
    return F.substring(data, -n, n)


def trim_eol(data: Column) -> Column:
    """Remove the whole run of CR and LF bytes at the end."""
    as_text = F.decode(data, ONE_BYTE_CHARSET)
    trimmed = F.encode(F.rtrim(as_text, F.lit("\r\n")), ONE_BYTE_CHARSET)
    return F.when(tail(data, 1).isin(CR, LF), trimmed).otherwise(data)


def trim_escaped_eol(data: Column) -> Column:
    r"""Remove one written-out ``\n`` at the end, then one written-out ``\r``."""
    last_two = tail(data, 2)
    cut = (
        F.when(tail(data, 4) == F.lit(rb"\r\n"), 4)
        .when((last_two == F.lit(rb"\n")) | (last_two == F.lit(rb"\r")), 2)
        .otherwise(0)
    )
    return F.substring(data, F.lit(1), F.octet_length(data) - cut)


def be_bytes(n: Column, width: int) -> Column:
    """Big-endian two's complement bytes of an integer column."""
    return F.unhex(be_hex(n, width))


def be_hex(n: Column, width: int) -> Column:
    digits = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    return F.substring(digits, 17 - 2 * width, 2 * width)


def be_uint(data: Column, position: Column | int, width: int) -> Column:
    """Unsigned big-endian integer of 1 to 7 bytes at a 1-based byte position; null when the bytes are not there."""
    at = F.lit(position) if isinstance(position, int) else position
    part = F.substring(data, at, F.lit(width))
    number = F.conv(F.hex(part), 16, 10).try_cast("bigint")
    return F.when(F.octet_length(part) == width, number)


def be_int64(data: Column, position: Column | int) -> Column:
    """Signed big-endian 8-byte integer at a 1-based byte position; null when the bytes are not there."""
    at = F.lit(position) if isinstance(position, int) else position
    part = F.substring(data, at, F.lit(8))
    number = F.conv(F.hex(part), 16, -10).try_cast("bigint")
    return F.when(F.octet_length(part) == 8, number)
