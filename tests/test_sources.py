"""Directory scans, offsets, and the growing-file stream."""

import os

import pytest
from pyspark.sql import functions as F

from podweave.operators.offsets import complete_lines, with_offsets
from podweave.operators.parsing import parse_lines
from podweave.sources.logdir import read_logs
from podweave.sources.tail import LinesLost, TailReader, stream_logs
from podweave.streaming.delivery import drain, start


def write(path, data, mode="wb"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as file:
        file.write(data)


def test_scan(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/ns_p_u/c/0.log", b"a\r\nb\xff\n\nlast")
    write(f"{root}/ns_p_u/c/x y%.log", b"z\n")
    write(f"{root}/ns_p_u/c/0.txt", b"no\n")
    write(f"{root}/ns_p_u/c/0.log.1", b"no\n")
    rows = read_logs(spark, root).withColumn("raw", F.col("line").cast("binary")).drop("line").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.chunk, r.line_id)):
        got.setdefault(r.path, []).append(bytes(r.raw))
    assert got == {f"{root}/ns_p_u/c/0.log": [b"a\r", b"b\xff", b"", b"last"], f"{root}/ns_p_u/c/x y%.log": [b"z"]}


def test_offsets_over_splits(spark, tmp_path):
    lines = [b"%d %s\r" % (i, b"x" * (i % 37)) for i in range(4000)]
    data = b"\n".join(lines) + b"\nopen end"
    write(f"{tmp_path}/a.log", data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        read = read_logs(spark, str(tmp_path))
        assert read.select("chunk").distinct().count() > 5
        placed = with_offsets(read).orderBy("offset").select("offset", "line", "file_size").collect()
        complete = complete_lines(with_offsets(read)).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line.encode() for r in placed] == [*lines, b"open end"]
    assert all(data[r.offset : r.offset + len(r.line)] == r.line.encode() for r in placed)
    assert complete == len(lines)


def run(spark, home, out, **options):
    """One drained run of a tail stream; returns what it delivered, per delta."""
    found = []

    def handle(rows, delta):
        found.append(sorted((os.path.basename(r.path), r.offset, bytes(r.line)) for r in
                            rows.withColumn("line", F.col("line").cast("binary")).collect()))

    start(stream_logs(spark, home, **options), handle, out).awaitTermination()
    return [f for f in found if f]


def test_tail(spark, tmp_path):
    logs, state = str(tmp_path / "logs"), str(tmp_path / "state")
    a, b = f"{logs}/pod/a.log", f"{logs}/pod/b.log"
    write(a, b"2025-11-03T07:41:52.123456789Z stdout F a line before it\n")
    assert run(spark, logs, state) == []
    write(a, b"second\nhalf", "ab")
    write(b, b"new file\n")
    write(f"{logs}/pod/.log", b"no extension\n")
    assert run(spark, logs, state) == [[("a.log", 57, b"second"), ("b.log", 0, b"new file")]]
    write(a, b" done\n", "ab")
    assert run(spark, logs, state) == [[("a.log", 64, b"half done")]]
    # Cut shorter: from the start. Replaced: from the start. Gone: forgotten, and new when it comes back.
    write(a, b"t\n")
    os.rename(b, f"{logs}/pod/b.old")
    assert run(spark, logs, state) == [[("a.log", 0, b"t")]]
    write(f"{logs}/pod/tmp", b"other\nlonger than before\n")
    os.rename(f"{logs}/pod/tmp", a)
    write(b, b"new file\n")
    assert run(spark, logs, state) == [
        [("a.log", 0, b"other"), ("a.log", 6, b"longer than before"), ("b.log", 0, b"new file")]]


def test_tail_splits_and_limits(spark, tmp_path):
    logs = str(tmp_path / "logs")
    lines = [b"line %d" % i for i in range(300)]
    write(f"{logs}/a.log", b"\n".join(lines) + b"\n")
    got = run(spark, logs, str(tmp_path / "s1"), starting="earliest", splitBytes=100)
    assert [line for _, _, line in got[0]] == sorted(lines, key=lines.index)

    found = []

    def handle(rows, delta):
        found.append([r.line for r in rows.orderBy("offset").collect()])

    write(f"{logs}/a.log", b"before\n")
    query = start(stream_logs(spark, logs, maxBytesPerTrigger=1000), handle, str(tmp_path / "s2"), every="0 seconds")
    query.processAllAvailable()
    write(f"{logs}/a.log", b"\n".join(lines) + b"\n", "ab")
    drain(query)
    assert [line.encode() for part in found for line in part] == lines
    assert len([part for part in found if part]) >= 3


def test_a_renamed_file_is_read_to_its_end(spark, tmp_path):
    logs, state = str(tmp_path / "logs"), str(tmp_path / "state")
    a = f"{logs}/pod/a.log"
    write(a, b"one\ntw")
    assert run(spark, logs, state, starting="earliest") == [[("a.log", 0, b"one")]]
    write(a, b"o\nthree\n", "ab")
    os.rename(a, f"{a}.1")
    write(a, b"new\n")
    assert run(spark, logs, state) == [[("a.log", 0, b"new"), ("a.log", 4, b"two"), ("a.log", 8, b"three")]]
    write(f"{a}.1", b"late\n", "ab")  # the writer still had it open
    os.rename(f"{a}.1", f"{logs}/a.old")
    assert run(spark, logs, state) == [[("a.log", 14, b"late")]]
    os.remove(f"{logs}/a.old")
    write(a, b"more\n", "ab")
    os.rename(a, f"{logs}/pod/moved.log")  # still a log, and still the same file
    assert run(spark, logs, state) == [[("a.log", 4, b"more")]]


def test_loss_is_an_error_unless_allowed(tmp_path):
    a = str(tmp_path / "a.log")
    write(a, b"x" * 9 + b"\n" + b"y" * 9 + b"\n")
    options = {"path": str(tmp_path), "startingPosition": "earliest", "maxBytesPerTrigger": "10"}
    reader = TailReader(options)
    start = reader.initialOffset()
    end = reader.latestOffset()
    (part,) = reader.partitions(start, end)
    assert [x.as_py() for b in reader.read(part) for x in b.column("line")] == [b"x" * 9]
    os.rename(a, str(tmp_path / "elsewhere"))  # a name of the same folder is found by the task
    assert [x.as_py() for b in reader.read(part) for x in b.column("line")] == [b"x" * 9]
    os.remove(str(tmp_path / "elsewhere"))
    with pytest.raises(LinesLost, match="10 bytes not read"):
        reader.latestOffset()
    with pytest.raises(LinesLost, match="bytes 0 to 10"):
        list(reader.read(part))
    lenient = TailReader({**options, "failOnDataLoss": "False"})
    lenient.reached = end
    assert lenient.latestOffset() == {} and list(lenient.read(part)) == []


def test_the_driver_opens_no_log(tmp_path, monkeypatch):
    write(str(tmp_path / "a.log"), b"one\ntwo")
    reader = TailReader({"path": str(tmp_path), "startingPosition": "earliest", "maxBytesPerTrigger": "5"})
    monkeypatch.setattr("builtins.open", None)
    start = reader.initialOffset()
    assert [e["end"] for e in reader.latestOffset().values()] == [5]
    assert [(p.start, p.end) for p in reader.partitions(start, reader.latestOffset())] == [(0, 7)]


def test_the_limit_holds_from_the_first_trigger_after_a_restart(spark, tmp_path):
    logs, state, progress = (str(tmp_path / x) for x in ("logs", "state", "progress.json"))
    lines = [b"line %04d" % i for i in range(200)]
    write(f"{logs}/a.log", b"\n".join(lines) + b"\n")
    sizes, got = [], []

    def handle(rows, delta):
        part = [bytes(r.line) for r in rows.withColumn("line", F.col("line").cast("binary")).orderBy("offset").collect()]
        sizes.append(sum(len(x) + 1 for x in part))
        got.extend(part)

    for _ in range(6):  # every run is a new start with one trigger
        stream = stream_logs(spark, logs, "earliest", maxBytesPerTrigger=500, progress=progress)
        start(stream, handle, state).awaitTermination()
    assert got == lines and len([x for x in sizes if x]) == 4 and max(sizes) <= 510


def test_events_of_a_tail_are_parsed(spark, tmp_path):
    logs, out = str(tmp_path / "logs"), str(tmp_path / "out")
    write(f"{logs}/a.log", b"2025-11-03T07:41:53.111222333Z stderr F and after it\nbad\n")
    events = parse_lines(stream_logs(spark, logs, "earliest")).select("stream", F.col("payload").cast("string").alias("p"))
    query = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
    query.trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("stderr", "and after it")]


def test_a_task_reads_many_small_files(tmp_path):
    for i in range(300):
        write(f"{tmp_path}/pod_{i:03d}/0.log", b"first %d\nsecond\nopen" % i)
    reader = TailReader({"path": str(tmp_path), "startingPosition": "earliest"})
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) == 1  # it was a task per file
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(os.path.basename(os.path.dirname(r["path"])), r["chunk"], r["offset"], r["line"]) for r in rows] == [
        row for i in range(300) for row in ((f"pod_{i:03d}", 0, 0, b"first %d" % i), (f"pod_{i:03d}", 0, len(f"first {i}") + 1, b"second"))]
    small = TailReader({"path": str(tmp_path), "startingPosition": "earliest", "splitBytes": "100"})
    assert len(small.partitions({}, small.latestOffset())) == 300
    os.remove(f"{tmp_path}/pod_007/0.log")
    with pytest.raises(LinesLost, match="pod_007"):
        list(reader.read(parts[0]))
