"""Line formats, timestamps, paths and rendering, one row per rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from podweave.functions.bytes import be_bytes, be_int64, be_uint
from podweave.functions.lines import FORMATS, LineFormat
from podweave.functions.paths import pod_metadata, uri_to_path
from podweave.functions.rendering import render_line
from podweave.functions.timestamps import civil_to_ns, format_time_of_day, is_leap, rfc3339_to_ns
from podweave.operators.parsing import malformed_lines, parse_all, parse_lines


def ns(text, nanos=0):
    moment = dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)
    return int(moment.timestamp()) * 10**9 + nanos


T = "2025-11-03T07:41:52"
BASE = ns(T)

LINES = [
    (f"{T}.123456789Z stdout F cache is warm\n", (BASE + 123456789, "stdout", False, b"cache is warm")),
    (f"{T}.123Z stderr P part of a line", (BASE + 123000000, "stderr", True, b"part of a line")),
    ("bad timestamp stdout F log", None),
    (f"{T}.123Z bad_stream F log", None),
    (f"{T}.123Z stdout X log", None),
    (r'{"log":"cache is warm\n","stream":"stdout","time":"' + T + '.123456789Z"}', (BASE + 123456789, "stdout", False, b"cache is warm")),
    (r'{"time":"' + T + '.123Z","stream":"stderr","log":"error log"}', (BASE + 123000000, "stderr", False, b"error log")),
    ('{"stream":"stdout"}', None),
    ("bad json content", None),
    ("", None),
    (" ", None),
    (f"{T}Z stdout F", None),
    (f"{T}Z stdout F ", (BASE, "stdout", False, b"")),
    (f"{T}Z stdout", None),
    (f"{T}Z stdout ", None),
    (f"{T}Z stdoutx F a", None),
    (f"{T}Z  stdout F a", None),
    (f"{T}Z stdout P:x rest", (BASE, "stdout", True, b"x rest")),
    (f"{T}Z stdout FFx", (BASE, "stdout", False, b"x")),
    (f"{T}Z stdout F a b  c ", (BASE, "stdout", False, b"a b  c ")),
    (f"{T}Z stdout F x\r\r\n\r", (BASE, "stdout", False, b"x")),
    (f"{T}Z stdout F \r\n", (BASE, "stdout", False, b"")),
    (f"{T}Z stdout F a\rb", (BASE, "stdout", False, b"a\rb")),
    (f"{T}Z stdout Féx", (BASE, "stdout", False, b"\xa9x")),
    (f"{T}Z stdout F é\U0001f600\r", (BASE, "stdout", False, "é\U0001f600".encode())),
    (b'\xff\xfe', None),
    (T.encode() + b"Z stderr F \xff\xfe\r", (BASE, "stderr", False, b"\xff\xfe")),
    (b'{"log":"\xff\xe2\\n","stream":"stderr","time":"' + T.encode() + b'Z"}', (BASE, "stderr", False, b"\xff\xe2")),
    # A brace line is JSON for good.
    ("{" + f"{T}Z stdout F x", None),
    (f' {{"log":"x","stream":"stdout","time":"{T}Z"}}', None),
    # First key wins, wherever it stands; null makes the next key the value.
    (f'{{"a":{{"log":"in"}},"log":"out","stream":"stdout","time":"{T}Z"}}', (BASE, "stdout", False, b"in")),
    (f'{{"log":null,"stream":"stdout","time":"{T}Z"}}', (BASE, "stdout", False, b"stream")),
    (f'{{"x":"log","log":"v","stream":"stdout","time":"{T}Z"}}', (BASE, "stdout", False, b"v")),
    (f'{{"x":"log","y":"w","stream":"stdout","time":"{T}Z"}}', (BASE, "stdout", False, b"w")),
    (f'{{"m":"\\"log\\":1","log":"v","stream":"stdout","time":"{T}Z"}}', (BASE, "stdout", False, b"v")),
    (f'{{"log":"","stream":"stdout","time":"{T}Z"}}', (BASE, "stdout", False, b"")),
    (f'{{"log" :  "v","stream":"stdout","time":"{T}Z"}}', (BASE, "stdout", False, b"v")),
    (f'{{"log":"never closed,stream:stdout,time:{T}Z', None),
    (f'{{"log":"v","stream":"other","time":"{T}Z"}}', None),
    (f'{{"log":"v","stream":"stdout","time":"{T}"}}', None),
    (f'{{"log":"v","stream":"stdout"}}', None),
    (r'{"log":"a\"b\tcé","stream":"stdout","time":"' + T + 'Z"}', (BASE, "stdout", False, r'a\"b\tcé'.encode())),
    (r'{"log":"x\r\n","stream":"stdout","time":"' + T + 'Z"}', (BASE, "stdout", False, b"x")),
    (r'{"log":"x\n\n","stream":"stdout","time":"' + T + 'Z"}', (BASE, "stdout", False, rb"x\n")),
    (r'{"log":"x\n\r","stream":"stdout","time":"' + T + 'Z"}', (BASE, "stdout", False, rb"x\n")),
    (r'{"log":"x\\n","stream":"stdout","time":"' + T + 'Z"}', (BASE, "stdout", False, b"x\\")),
    (r'{"log":"\n","stream":"stdout","time":"' + T + 'Z"}', (BASE, "stdout", False, b"")),
    ('{"log":"' + r'\"' * 250_000 + '","stream":"stdout","time":"' + T + 'Z"}', (BASE, "stdout", False, rb'\"' * 250_000)),
    (f"{T}Z stdout F " + "\r" * 100_000 + "x", (BASE, "stdout", False, b"\r" * 100_000 + b"x")),
]

TIMES = [
    (T, None),  # 19 bytes
    (T + "?", BASE),
    (T + "Zjunk", BASE),
    (T + ".Z", BASE),
    (T + ".5", BASE + 500_000_000),
    (T + ".123456789987654321Z", BASE + 123456789),
    (T + "+05:30", BASE - 19800 * 10**9),
    (T + ".25-07:00", BASE + 250_000_000 + 25200 * 10**9),
    (T + "-07-00", BASE + 25200 * 10**9),
    (T + "+05:30:99", BASE - 19800 * 10**9),
    (T + "+0530", BASE),
    (T + "+0x:30", None),
    (T + "+05:3x", None),
    (T + "+05é30", None),
    (T + "+99:99", BASE - (99 * 3600 + 99 * 60) * 10**9),
    (T + "Z+05:30", BASE),
    ("2025-11-03 07:41:52Z", None),
    ("2025/11/03T07:41:52Z", None),
    ("2025-11-03T07:41:5.Z", None),
    ("+025-11-03T07:41:52Z", None),
    ("2026-00-05T00:00:00Z", ns("2026-01-05T00:00:00")),
    ("2026-13-01T00:00:00Z", ns("2027-01-01T00:00:00")),
    ("2026-14-01T00:00:00Z", None),
    ("2024-13-01T00:00:00Z", ns("2025-01-01T00:00:00")),
    ("2024-14-01T00:00:00Z", None),
    ("2024-77-01T00:00:00Z", None),
    ("2025-99-01T00:00:00Z", None),
    ("2026-02-30T00:00:00Z", ns("2026-03-02T00:00:00")),
    ("2024-02-30T00:00:00Z", ns("2024-03-01T00:00:00")),
    ("2026-01-00T00:00:00Z", ns("2025-12-31T00:00:00")),
    ("2026-01-01T25:61:61Z", ns("2026-01-02T02:02:01")),
    ("1969-12-31T00:00:00Z", ns("1970-12-31T00:00:00")),
    ("0000-03-01T00:00:00Z", ns("1970-03-02T00:00:00")),
    ("2000-02-29T23:59:59.999999999Z", ns("2000-02-29T23:59:59", 999999999)),
    ("2100-03-01T00:00:00Z", ns("2100-03-01T00:00:00")),
    ("2262-04-11T23:47:16.854775807Z", 2**63 - 1),
    ("2262-04-11T23:47:16.854775808Z", None),
    ("2300-01-01T00:00:00Z", None),
    ("9999-12-31T23:59:59Z", None),
    ("", None),
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, bytearray(x.encode() if isinstance(x, str) else x)) for i, (x, _) in enumerate(LINES)]
    df = spark.createDataFrame(rows, "i int, raw binary")
    return df.select("i", F.col("raw").cast("string").alias("line")).cache()


def parsed(rows):
    return {r.i: (r.timestamp_ns, r.stream, r.is_partial, bytes(r.payload)) for r in rows}


def test_lines(lines):
    got = parsed(parse_lines(lines).drop("line").collect())
    for i, (line, expected) in enumerate(LINES):
        assert got.get(i) == expected, line[:100]


def test_malformed_is_the_complement(lines):
    bad = {r.i for r in malformed_lines(lines).drop("line").collect()}
    assert bad == {i for i, (_, expected) in enumerate(LINES) if expected is None}
    both = parse_all(lines).drop("line").where("timestamp_ns IS NULL AND payload IS NULL AND is_partial IS NULL")
    assert both.count() == len(bad)


def test_a_user_format(spark):
    pipes = LineFormat("pipes", lambda l: l.startswith("|"), lambda l: F.struct(
        F.split_part(l, F.lit("|"), F.lit(2)).alias("time"), F.when(l.isNotNull(), "stdout").alias("stream"),
        F.when(l.isNotNull(), False).alias("is_partial"), F.split_part(l, F.lit("|"), F.lit(3)).cast("binary").alias("payload")))
    df = spark.createDataFrame([(0, f"|{T}Z|abc"), (1, f"{T}Z stderr P x")], "i int, line string")
    got = parsed(parse_lines(df, formats=(pipes, *FORMATS)).collect())
    assert got == {0: (BASE, "stdout", False, b"abc"), 1: (BASE, "stderr", True, b"x")}


def test_timestamps(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string")
    got = {r.i: r.ns for r in df.select("i", rfc3339_to_ns(F.col("t")).alias("ns")).collect()}
    for i, (text, expected) in enumerate(TIMES):
        assert got[i] == expected, text


def test_civil_days_over_four_centuries(spark):
    days = spark.range(0, 120_000, 17).select(F.expr("date_add(date'1970-01-01', cast(id as int))").alias("d"), "id")
    nanos = civil_to_ns(F.year("d"), F.month("d"), F.day("d"), F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    wrong = days.select("d", F.when(F.year("d") < 2262, nanos == F.col("id") * 86_400 * 10**9).alias("ok"))
    assert wrong.where("NOT ok").count() == 0
    years = spark.range(1900, 2300).select("id", is_leap(F.col("id")).alias("leap"))
    assert years.where(f"leap <> (day(last_day(make_date(cast(id as int), 2, 1))) = 29)").count() == 0


PATHS = [
    ("/var/log/pods/shop_cart-77d_0c1d2e3/till/0.log", ("shop", "cart-77d", "0c1d2e3", "till")),
    ("/x/ns_a_b_c_u/c/0.log", ("ns", "a_b_c", "u", "c")),
    ("/x/ns_pod/c/0.log", ("ns", "0.log", "unknown", "c")),
    ("/x/plain/c/0.log", ("default", "0.log", "unknown", "c")),
    ("/x/_p_u/c/0.log", ("", "p", "u", "c")),
    ("/x/ns__/c/0.log", ("ns", "", "", "c")),
    ("/x/ns_/c/0.log", ("ns", "0.log", "unknown", "c")),
    ("/x.log", ("default", "x.log", "unknown", "unknown")),
    ("x.log", ("default", "x.log", "unknown", "unknown")),
    ("/c/x.log", ("default", "x.log", "unknown", "c")),
    ("c/x.log", ("default", "x.log", "unknown", "c")),
]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p, _ in PATHS], "path string")
    for row, (path, expected) in zip(df.select(pod_metadata(F.col("path")).alias("m")).collect(), PATHS):
        assert tuple(row.m) == expected, path
    uris = spark.createDataFrame([("file:/a/b%20c+d/0.log",), ("file:///a/0.log",), ("hdfs://host:1/a/0.log",), ("/a",)], "u string")
    assert [r[0] for r in uris.select(uri_to_path(F.col("u"))).collect()] == ["/a/b c+d/0.log", "/a/0.log", "/a/0.log", "/a"]


def test_rendering(spark):
    df = spark.createDataFrame([(True, 7, BASE + 123456999, "x"), (False, 1, -1, ""), (False, 2, -10**9, "y")],
                               "e boolean, id bigint, ns bigint, p string")
    line = render_line(F.col("e"), F.col("id"), F.col("ns"), F.col("p").cast("binary"))
    assert [r[0] for r in df.select(line).collect()] == [
        "[stderr] StreamID: 7 | Time: 07:41:52.123456 | Msg: x",
        "[stdout] StreamID: 1 | Time: 23:59:59.999999 | Msg: ",
        "[stdout] StreamID: 2 | Time: 23:59:59.000000 | Msg: y",
    ]
    assert df.select(format_time_of_day(F.col("ns"))).first()[0] == "07:41:52.123456"


def test_big_endian(spark):
    values = [0, 1, 255, 65536, 2**32 - 1, -1, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = df.select(be_bytes(F.col("v"), 8).alias("b8"), be_bytes(F.col("v"), 4).alias("b4"),
                    be_int64(be_bytes(F.col("v"), 8), 1).alias("back"),
                    be_uint(be_bytes(F.col("v"), 4), 1, 4).alias("low")).collect()
    for v, row in zip(values, got):
        assert bytes(row.b8) == v.to_bytes(8, "big", signed=True)
        assert bytes(row.b4) == (v % 2**32).to_bytes(4, "big")
        assert row.back == v and row.low == v % 2**32
    short = spark.range(1).select(be_uint(F.unhex(F.lit("0001")), 1, 4), be_int64(F.unhex(F.lit("0001")), 1)).first()
    assert tuple(short) == (None, None)
