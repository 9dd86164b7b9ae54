"""Frame layout, decoding and its errors, captures."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from podweave.operators.chains import TOGETHER, events_of, walked
from podweave.operators.frames import (
    SHORT,
    TOO_LARGE,
    UNKNOWN_TYPE,
    batch_payload,
    decode_events,
    decode_registers,
    frame_bytes,
    inspect_batches,
    register_payload,
    split_frames,
)
from podweave.plans.receive import judge_batches, receive
from podweave.sources.capture import TRUNCATED, read_capture, splits_of, write_capture


def register(stream_id, *names):
    return struct.pack(">I", stream_id) + b"".join(struct.pack(">H", len(n)) + n for n in names)


def batch(stream_id, *events):
    return struct.pack(">II", stream_id, len(events)) + b"".join(
        struct.pack(">qBI", ns, flag, len(data)) + data for ns, flag, data in events)


EVENTS = [(1000000001, 0, b"first of three"), (1000000002, 1, b"second, on the other stream"), (-5, 1, b"\xff\xfe")]


def test_layout(spark):
    names = ("shop", "cart", "0c1-d2e", "web")
    row = spark.range(1).select(
        register_payload(F.lit(7), *(F.lit(n) for n in names)).alias("r"),
        batch_payload(F.lit(99), F.array(*(
            F.struct(F.lit(ns).alias("timestamp_ns"), F.lit(bool(e)).alias("is_stderr"), F.lit(d).alias("payload"))
            for ns, e, d in EVENTS))).alias("b"),
        frame_bytes(F.lit(2), F.unhex(F.lit("00" * 42))).alias("f"),
    ).first()
    assert bytes(row.r) == register(7, *(n.encode() for n in names)) and len(row.r) == 30
    assert bytes(row.b) == batch(99, *EVENTS)
    assert bytes(row.f)[:5] == bytes([0, 0, 0, 42, 2])


def frames(spark, rows):
    return spark.createDataFrame([(i, t, bytearray(p)) for i, (t, p) in enumerate(rows)], "seq bigint, type int, payload binary")


def plain(payload):
    """(stream id, events, sound) of one payload, followed byte by byte."""
    if payload is None or len(payload) < 8:
        return None, [], False
    stream_id, count = struct.unpack_from(">II", payload)
    events, at = [], 8
    for _ in range(count):
        if at + 13 > len(payload):
            return stream_id, [], False
        ns, flag, size = struct.unpack_from(">qBI", payload, at)
        at += 13 + size
        if at > len(payload):
            return stream_id, [], False
        events.append((ns, flag != 0, payload[at - size : at]))
    return stream_id, events, True


@pytest.mark.parametrize("rows", [0, 1, TOGETHER - 1, 300])
def test_chains_are_the_plain_walk(rows):
    chance = random.Random(rows)
    made = []
    for i in range(rows):
        events = [(chance.randint(-2**63, 2**63 - 1), chance.choice([0, 1, 255]), chance.randbytes(chance.choice([0, 0, 1, 40])))
                  for _ in range(chance.choice([0, 1, 3, 200 if i % 50 == 0 else 7]))]
        whole = batch(chance.getrandbits(32), *events)
        broken = [whole[:-1], whole[:-9], whole[: chance.randint(0, len(whole))], whole[:4] + b"\xff" * 4 + whole[8:],
                  whole + b"\0\xff", None, b""]
        made.append(chance.choice([whole] * 6 + broken))
    payloads = pa.array([b"left out", *made, b"left out"], pa.binary()).slice(1, rows)
    chains = walked(payloads)
    assert chains.sound.tolist() == [plain(x)[2] for x in made]
    ids = zip(chains.stream_id.tolist(), chains.told.tolist(), strict=True)
    assert [x if told else None for x, told in ids] == [plain(x)[0] for x in made]
    got = zip(chains.frame.tolist(), chains.number.tolist(), *(x.to_pylist() for x in events_of(chains)), strict=True)
    assert list(got) == [(i, k, *event) for i, x in enumerate(made) for k, event in enumerate(plain(x)[1])]


def test_decoding_and_errors(spark):
    good = batch(99, *EVENTS)
    rows = [(2, good), (2, good + b"\x00\xff"), (2, good[:-1]), (2, b"\x00" * 7), (2, batch(5)),
            (2, struct.pack(">II", 1, 2**32 - 1)), (2, struct.pack(">IIqBI", 1, 1, 0, 7, 0)),
            (3, good), (2, b"\x00" * 65_536), (2, b"\x00" * 65_537)]
    _, batches, bad = split_frames(frames(spark, rows))
    got = {}
    for r in decode_events(batches).collect():
        got.setdefault(r.seq, []).append(r.error or (r.idx, r.stream_id, r.timestamp_ns, r.is_stderr, bytes(r.payload)))
    whole = [(i, 99, ns, bool(e), d) for i, (ns, e, d) in enumerate(EVENTS)]
    assert sorted(got.pop(0)) == whole and sorted(got.pop(1)) == whole
    assert got == {2: [SHORT], 3: [SHORT], 5: [SHORT], 6: [(0, 1, 0, True, b"")]}
    assert {r.seq: r.error for r in bad.collect()} == {7: UNKNOWN_TYPE, 9: TOO_LARGE}
    counts = {r.seq: (r.stream_id, r.event_count, r.error) for r in inspect_batches(batches).collect()}
    assert counts[0] == (99, 3, None) and counts[4] == (5, 0, None) and counts[2] == (99, 0, SHORT)
    assert plain(good)[1][2] == (-5, True, b"\xff\xfe")


def test_registers(spark):
    sound = register(42, b"shop", b"cart-77d", b"0c1d2e3", b"till")
    rows = [(1, sound), (1, sound + b"x"), (1, sound[:-1]), (1, register(1, b"", b"", b"", b"")), (1, b"\x00" * 11)]
    got = {r.seq: r for r in decode_registers(split_frames(frames(spark, rows))[0]).collect()}
    for seq in (0, 1):
        assert tuple(got[seq])[1:] == (42, "shop", "cart-77d", "0c1d2e3", "till", None)
    assert got[2].error == SHORT and got[2].stream_id is None
    assert tuple(got[3])[1:] == (1, "", "", "", "", None)
    assert got[4].error == SHORT


def test_fail_fast(spark):
    with pytest.raises(Exception, match="unknown frame type"):
        split_frames(frames(spark, [(9, b"")]), fail_fast=True)[1].collect()


def test_captures(spark, tmp_path):
    rows = [(f"c{i % 2}", i, 2, bytearray(batch(i, (i, 0, b"x" * i)))) for i in range(60)]
    df = spark.createDataFrame(rows, "conn string, seq bigint, type int, payload binary")
    write_capture(df, str(tmp_path / "cap"), 20)
    assert len(list((tmp_path / "cap").glob("job-*/c0/*.frames"))) == 3
    got = read_capture(spark, str(tmp_path / "cap")).orderBy("conn", "seq").collect()
    assert [(r.conn, r.seq, r.type, bytes(r.payload)) for r in got] == [(c, n, t, bytes(p)) for c, n, t, p in sorted(rows)]


def test_copying_a_capture_leaves_it_alone(spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    rows = [(c, 10 * i - 7, 2, bytearray(batch(i))) for i in range(1, 6) for c in ("east/one", "west")]
    write_capture(spark.createDataFrame(rows, "conn string, seq bigint, type int, payload binary"), first)
    before = {p: p.read_bytes() for p in (tmp_path / "a").rglob("*") if p.is_file()}
    write_capture(read_capture(spark, first).where("seq < 20"), second)
    write_capture(read_capture(spark, first).where("seq < 20"), first)  # a second write adds
    assert {p: p.read_bytes() for p in before} == before
    few = sorted((c, n) for c, n, _, _ in rows if n < 20)
    assert sorted((r.conn, r.seq) for r in read_capture(spark, second).collect()) == few
    assert read_capture(spark, first).count() == len(rows) + len(few)


@pytest.mark.parametrize("conn", ["/etc/x", "../x", "a/../../x", "", None, "a//b", "_hidden"])
def test_capture_stays_in_its_directory(spark, tmp_path, conn):
    df = spark.createDataFrame([(conn, 0, 2, bytearray(batch(1)))], "conn string, seq bigint, type int, payload binary")
    with pytest.raises(Exception, match="no name for a connection"):
        write_capture(df, str(tmp_path / "cap"))
    assert not list(tmp_path.rglob("*.frames"))


def test_receiver_quarantine(spark):
    rows = [("c", 0, 2, batch(1, (5, 0, b"x"))), ("c", 1, 2, b"0" * 7), ("c", 2, 9, b"abc"), ("c", 3, 1, b"0" * 5), ("c", 4, 2, b"y" * 70_000)]
    df = spark.createDataFrame([(*r[:3], bytearray(r[3]), r[1]) for r in rows], "conn string, seq bigint, type int, payload binary, clock_ms bigint")
    verdicts, bad = judge_batches(df)
    assert [(r.seq, r.admitted) for r in verdicts.collect()] == [(0, True)]
    assert sorted(map(tuple, bad.collect())) == [
        ("c", 1, 2, 7, SHORT), ("c", 2, 9, 3, UNKNOWN_TYPE), ("c", 3, 1, 5, SHORT), ("c", 4, 2, 70_000, TOO_LARGE)]
    events, again = receive(df)
    assert [bytes(r.payload) for r in events.collect()] == [b"x"] and again.count() == 4
    for at, why in ((1, SHORT), (2, UNKNOWN_TYPE), (3, SHORT), (4, TOO_LARGE)):
        with pytest.raises(Exception, match=why):
            judge_batches(df.where(f"seq = {at}"), fail_fast=True)


def test_capture_ends(spark, tmp_path):
    one = struct.pack(">IB", 30, 2) + batch(11, (42, 0, b"over wire"))
    assert len(one) == 35
    for name, data in (("whole", one * 2), ("empty", b""), ("header", one + b"\x00\x00"), ("payload", one + one[:-1]),
                       ("bare", one + one[:5])):
        (tmp_path / f"{name}.frames").write_bytes(data)
    got = {}
    for r in read_capture(spark, str(tmp_path)).collect():
        got.setdefault(r.conn, []).append(r.error)
    assert got == {"whole.frames": [None, None], "header.frames": [None, TRUNCATED],
                   "payload.frames": [None, TRUNCATED], "bare.frames": [None, TRUNCATED]}


@pytest.mark.parametrize("tail", [b"", b"\x00\x00", struct.pack(">IB", 50, 2) + b"short", struct.pack(">IB", 1 << 31, 2) + b"x"])
def test_splits_of_a_capture_are_the_walk(spark, tmp_path, tail):
    rng = random.Random(len(tail))
    sizes = [rng.choice([0, 0, 1, 7, 200, 900, 5000]) for _ in range(400)] + [70_000, 0, 3]
    frames = [(1 + k % 3, rng.randbytes(n) if k % 4 else b"\x00" * n) for k, n in enumerate(sizes)]
    (tmp_path / "a.frames").write_bytes(b"".join(struct.pack(">IB", len(p), kind) + p for kind, p in frames) + tail)
    whole = read_capture(spark, str(tmp_path), max_payload=1 << 30).orderBy("seq").collect()
    assert [(r.type, bytes(r.payload)) for r in whole[: len(frames)]] == frames and [r.seq for r in whole] == list(range(len(whole)))
    assert len(whole) == len(frames) + bool(tail)
    for split in (20_000, 100_000):
        read = read_capture(spark, str(tmp_path), split).withColumn("task", F.spark_partition_id())
        assert [tuple(r)[:-1] for r in read.orderBy("seq").collect()] == [tuple(r) for r in whole]
        assert split > 20_000 or read.select("task").distinct().count() > 8


def test_splits_keep_numbers(spark, tmp_path):
    rows = [("c", 3 * k, 2, bytes([k % 256]) * (k % 50)) for k in range(500)]
    write_capture(spark.createDataFrame(rows, "conn string, seq bigint, type int, payload binary"), str(tmp_path), 10**6)
    got = read_capture(spark, str(tmp_path), 500).orderBy("seq").collect()
    assert [(r.conn, r.seq, r.type, bytes(r.payload)) for r in got] == rows


def test_splits_read_headers_only(tmp_path):
    (tmp_path / "a.frames").write_bytes(b"".join(struct.pack(">IB", 1 << 20, 2) + b"x" * (1 << 20) for _ in range(20)))
    found = list(splits_of(str(tmp_path), str(tmp_path / "a.frames"), 20 * ((1 << 20) + 5), 3 << 20))
    step = (1 << 20) + 5
    assert found == [(k * step, min(k + 3, 20) * step, k) for k in range(0, 20, 3)]
