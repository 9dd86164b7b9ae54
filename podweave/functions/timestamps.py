"""RFC 3339 text to epoch nanoseconds and back to a time of day.

Nanoseconds stay in BIGINT from end to end: Spark's timestamps hold microseconds. The calendar is arithmetic with
roll-over (hour 25 is the next day, February 30 is in March), so no timestamp cast can stand in for it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from podweave.functions.bytes import ONE_BYTE_CHARSET, div, floor_div

NANOS = 1_000_000_000


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01. Years before 1970 add none; month 0 is January's start, 13 the next January, 14 null."""
    past = F.greatest(year, F.lit(1970)) - 1
    leap_days = div(past, 4) - div(past, 100) + div(past, 400) - 477
    year_days = 365 * (past - 1969) + leap_days
    from_march = F.when(month <= 2, 0).when((month <= 13) & is_leap(year), -1).when(month <= 13, -2)
    month_days = div(367 * F.greatest(month, F.lit(1)) - 362, 12) + from_march
    return year_days + month_days + day - 1


def civil_to_seconds(year, month, day, hour, minute, second) -> Column:
    return days_from_civil(year, month, day) * 86400 + hour * 3600 + minute * 60 + second


def civil_to_ns(year, month, day, hour, minute, second, nanos) -> Column:
    """Epoch nanoseconds of a civil date and time; null where they leave the 64-bit range."""
    seconds = civil_to_seconds(year, month, day, hour, minute, second).cast("bigint")
    return F.try_add(F.try_multiply(seconds, F.lit(NANOS)), nanos.cast("bigint"))


def rfc3339_to_ns(text: Column) -> Column:
    """Epoch nanoseconds of ``YYYY-MM-DDTHH:MM:SS[.fraction][offset]``; null when the text does not parse.

    At least 20 bytes are needed. The fraction counts to nine digits. An offset of six bytes or more is taken off the
    time; a shorter one, and any other text after the fraction, is ignored.
    """
    # Byte positions matter behind the seconds, so text beyond ASCII is looked at one byte per character.
    ascii_only = F.octet_length(text) == F.char_length(text)
    view = F.when(ascii_only, text).otherwise(F.decode(text.cast("binary"), ONE_BYTE_CHARSET))
    # No condition stands around a shared part: Spark computes it once only where it is always needed.
    rest = F.substring(view, 20, 1_000_000_000)
    fraction = F.regexp_extract(rest, r"^\.([0-9]*)", 1)
    nanos = F.rpad(F.substring(fraction, 1, 9), 9, "0").cast("bigint")
    after = F.substr(rest, F.char_length(fraction) + rest.startswith(".").cast("int") + 1)
    shifted = F.substring(after, 1, 1).isin("+", "-") & (F.char_length(after) >= 6)
    offset = F.when(shifted, _rarely(offset_to_seconds, after)).otherwise(F.lit(0).cast("bigint"))
    seconds = F.try_subtract(civil_text_to_seconds(view), offset)
    return F.try_add(F.try_multiply(seconds, F.lit(NANOS)), nanos)


def _rarely(f, value: Column) -> Column:
    """f(value) as a lambda: kept out of the generated code, which the JVM compiles only while it is short."""
    return F.transform(F.array(value), f)[0]


def civil_text_to_seconds(text: Column) -> Column:
    """Epoch seconds of leading ``YYYY-MM-DDTHH:MM:SS`` digits with roll-over; null without them or nothing behind."""
    shape = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?s:.)"
    digits = F.translate(F.regexp_extract(text, shape, 1), "-T:", "").try_cast("bigint")

    def field(scale: int, size: int) -> Column:
        return div(digits, scale) % size

    return civil_to_seconds(
        field(10_000_000_000, 10_000),
        field(100_000_000, 100),
        field(1_000_000, 100),
        field(10_000, 100),
        field(100, 100),
        field(1, 100),
    )


def offset_to_seconds(offset: Column) -> Column:
    """Seconds of a UTC offset ``+hh:mm`` or ``-hh:mm``; null for anything but digits in it."""
    hours_minutes = F.concat(F.substring(offset, 2, 2), F.substring(offset, 5, 2))
    number = F.when(hours_minutes.rlike("^[0-9]{4}$"), hours_minutes.cast("bigint"))
    seconds = div(number, 100) * 3600 + number % 100 * 60
    return F.when(offset.startswith("-"), -seconds).otherwise(seconds)


def format_time_of_day(timestamp_ns: Column) -> Column:
    """UTC time of day ``HH:MM:SS.ffffff``, cut (not rounded) to microseconds; any session time zone."""
    micros = F.pmod(floor_div(timestamp_ns, 1000), F.lit(86_400_000_000))
    seconds = div(micros, 1_000_000)

    def two(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    return F.concat(
        two(div(seconds, 3600)), F.lit(":"), two(div(seconds, 60) % 60), F.lit(":"), two(seconds % 60),
        F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"),
    )
