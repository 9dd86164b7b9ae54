"""Receiver side: frames to admitted events, and a way out for the frames that are none."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podweave.operators.admission import admit
from podweave.operators.asof import latest_registration
from podweave.operators.chunks import add_chunk, settle
from podweave.operators.frames import (
    NAMES,
    check_frames,
    decode_events,
    decode_registers,
    inspect_batches,
    split_frames,
)
from podweave.settings import BURST, CHUNK_SPAN, FRAME_BATCH, FRAME_REGISTER, RATE_PER_SECOND

STREAM = ["conn", "stream_id"]
QUARANTINE = ["conn", "seq", "type", "bytes", "error"]


def inspected(frames: DataFrame, clock_ms: str = "clock_ms", fail_fast: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(register frames decoded, batch frames measured, quarantine), the first two stored and without a payload.

    Every payload is looked at once. The quarantine has ``conn, seq, type, bytes, error`` of each frame that is too
    large, of unknown type, broken, or came with an error; with ``fail_fast`` such a frame ends the job instead.
    """
    checked = check_frames(frames).withColumn("bytes", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint"))
    sound = checked.where(F.col("error").isNull()).drop("error")
    fields = ["conn", "seq", clock_ms, "bytes"]
    registers = decode_registers(sound.where(F.col("type") == FRAME_REGISTER).select(*fields, "type", "payload"))
    batches = inspect_batches(sound.where(F.col("type") == FRAME_BATCH).select(*fields, "payload"))
    bad = checked.where(F.col("error").isNotNull()).select(*QUARANTINE)
    if fail_fast:
        stop = lambda rows: rows.withColumn("error", F.when(
            F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad frame: "), "error")).cast("string")))
        registers, batches = stop(registers), stop(batches)
        settle(stop(bad))
    registers, batches = settle(registers), settle(batches)
    broken = [rows.where(F.col("error").isNotNull()).withColumn("type", F.lit(kind)).select(*QUARANTINE)
              for rows, kind in ((registers, FRAME_REGISTER), (batches, FRAME_BATCH))]
    good = [rows.where(F.col("error").isNull()).drop("error", "bytes") for rows in (registers, batches)]
    return *good, bad.unionByName(broken[0]).unionByName(broken[1])


def judge_batches(frames: DataFrame, clock_ms: str = "clock_ms", rate: int = RATE_PER_SECOND, burst: int = BURST,
                  span: int = CHUNK_SPAN, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(verdicts, quarantine): ``conn, seq, clock, stream_id, event_count, admitted`` and the pod identity of every sound
    batch frame; and the frames that are not sound, with the reason.

    A registration refills its stream's bucket, and names the batches behind it. No payload leaves its task.
    """
    registered, sound, quarantine = inspected(frames, clock_ms, fail_fast)
    registered = add_chunk(registered, "seq", span)
    requests = add_chunk(sound, "seq", span).withColumn("reset", F.lit(False)).unionByName(
        registered.drop(*NAMES).withColumns({"event_count": F.lit(0).cast("bigint"), "reset": F.lit(True)})
    )
    # Stored, as the join below reads the verdicts twice.
    verdicts = settle(admit(requests, STREAM, "chunk", "seq", clock_ms, "event_count", rate, burst, "reset"))
    named = latest_registration(verdicts.drop("reset"), registered.drop(clock_ms), STREAM, "chunk", "seq")
    return named.drop("chunk"), quarantine


def receive(frames: DataFrame, clock_ms: str = "clock_ms", rate: int = RATE_PER_SECOND, burst: int = BURST,
            span: int = CHUNK_SPAN, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(admitted events with their pod identity, quarantine): ``conn, seq, idx, stream_id, timestamp_ns, is_stderr,
    payload``…, and what was no sound frame.

    Payloads are shuffled once, by frame, to meet the verdicts; only those of admitted frames are decoded.
    """
    verdicts, quarantine = judge_batches(frames, clock_ms, rate, burst, span, fail_fast)
    _, batches, _ = split_frames(frames)
    admitted = verdicts.where("admitted").select("conn", "seq", *NAMES)
    events = decode_events(batches.select("conn", "seq", "payload").join(admitted, ["conn", "seq"])).drop("error")
    return events, quarantine
