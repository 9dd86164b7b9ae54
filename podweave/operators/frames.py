"""Binary frames: a 4-byte big-endian payload length, one byte of kind, the payload.

Kind 1 registers a stream, kind 2 carries a batch of events. ``frames`` tables hold ``type INT, payload BINARY`` and
whatever identifies the frame (conn, seq).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from podweave.functions.bytes import be_hex, be_uint
from podweave.operators.chains import events_of, walked
from podweave.settings import FRAME_BATCH, FRAME_MAX_PAYLOAD, FRAME_REGISTER

SHORT = "unexpected end of payload"
TOO_LARGE = "payload larger than the frame limit"
UNKNOWN_TYPE = "unknown frame type"

NAMES = ("namespace", "pod_name", "pod_uid", "container_name")


def event_hex(timestamp_ns: Column, is_stderr: Column, payload: Column) -> Column:
    data = payload.cast("binary")
    flag = F.when(is_stderr, "01").otherwise("00")
    return F.concat(be_hex(timestamp_ns, 8), flag, be_hex(F.octet_length(data), 4), F.hex(data))


def batch_payload(stream_id: Column, events: Column) -> Column:
    """Payload of a batch frame; ``events`` is an array of structs with timestamp_ns, is_stderr and payload."""
    bodies = F.transform(events, lambda e: event_hex(e["timestamp_ns"], e["is_stderr"], e["payload"]))
    return F.unhex(F.concat(be_hex(stream_id, 4), be_hex(F.size(events), 4), F.array_join(bodies, "")))


def register_payload(stream_id: Column, *names: Column) -> Column:
    """Payload of a register frame: the id, then namespace, pod name, pod uid and container, each behind its length."""
    parts = []
    for name in names:
        data = name.cast("binary")
        parts += [be_hex(F.octet_length(data), 2), F.hex(data)]
    return F.unhex(F.concat(be_hex(stream_id, 4), *parts))


def frame_bytes(kind: Column, payload: Column) -> Column:
    """A whole frame as it stands in a capture."""
    return F.unhex(F.concat(be_hex(F.octet_length(payload), 4), be_hex(kind, 1), F.hex(payload)))


def encode_batches(batches: DataFrame) -> DataFrame:
    """Batches (``stream_id``, ``events``) as frames; an empty batch is not sent."""
    sent = batches.where(F.size("events") > 0).withColumn("type", F.lit(FRAME_BATCH))
    return sent.withColumn("payload", batch_payload(F.col("stream_id"), F.col("events"))).drop("events")


def encode_registry(registry: DataFrame) -> DataFrame:
    payload = register_payload(F.col("stream_id"), *(F.col(n) for n in NAMES))
    return registry.withColumn("type", F.lit(FRAME_REGISTER)).withColumn("payload", payload).drop(*NAMES)


def check_frames(frames: DataFrame, limit: int = FRAME_MAX_PAYLOAD) -> DataFrame:
    """Add ``error``: an unknown type or a payload over the limit; an error that is there already stays."""
    found = F.when(F.octet_length("payload") > limit, TOO_LARGE).when(
        ~F.col("type").isin(FRAME_REGISTER, FRAME_BATCH), UNKNOWN_TYPE
    )
    earlier = [F.col("error")] if "error" in frames.columns else []
    return frames.withColumn("error", F.coalesce(*earlier, found))


def split_frames(frames: DataFrame, limit: int = FRAME_MAX_PAYLOAD, fail_fast: bool = False):
    """(register frames, batch frames, bad frames). With ``fail_fast`` a bad frame ends the job instead."""
    checked = check_frames(frames, limit)
    if fail_fast:
        stop = F.raise_error(F.concat(F.lit("bad frame: "), "error")).cast("string")
        checked = checked.withColumn("error", F.when(F.col("error").isNotNull(), stop))
    good = checked.where(F.col("error").isNull())
    return (
        good.where(F.col("type") == FRAME_REGISTER).drop("error"),
        good.where(F.col("type") == FRAME_BATCH).drop("error"),
        checked.where(F.col("error").isNotNull()),
    )


def decode_registers(frames: DataFrame) -> DataFrame:
    """Register frames to ``stream_id`` and the four names, with ``error`` where a length field leads out of the payload."""
    data = F.col("payload")
    staged, at = frames.withColumn("_id", be_uint(data, 1, 4)), F.lit(5)
    for name in NAMES:
        length, text = f"_n_{name}", f"_t_{name}"
        staged = staged.withColumn(length, be_uint(data, at, 2))
        staged = staged.withColumn(text, F.substring(data, at + 2, F.col(length).cast("int")))
        at = at + 2 + F.col(length).cast("int")
    whole = (F.octet_length(data) >= 12) & F.coalesce(at - 1 <= F.octet_length(data), F.lit(False))
    record = F.struct(
        F.when(whole, F.col("_id")).alias("stream_id"),
        *(F.when(whole, F.col(f"_t_{n}").cast("string")).alias(n) for n in NAMES),
        F.when(~whole, SHORT).alias("error"),
    )
    # As a table function, so that a filter on the outcome does not pull the nested positions into itself.
    return staged.select(*(c for c in frames.columns if c not in ("payload", "type")), F.inline(F.array(record)))


def inspect_batches(frames: DataFrame) -> DataFrame:
    """Batch frames without their payload: ``stream_id, event_count, error``. All that routing and admission need;
    a payload whose lengths lead out of it has an error, so that it is not charged.
    """
    kept = [c for c in frames.columns if c not in ("payload", "type", "error")]
    added = [("stream_id", LongType()), ("event_count", LongType()), ("error", StringType())]
    schema = StructType([frames.schema[c] for c in kept] + [StructField(*field) for field in added])

    def inspect(batches):
        for batch in batches:
            chains = walked(batch.column("payload"))
            columns = [batch.column(c) for c in kept]
            columns.append(pa.array(chains.stream_id, mask=~chains.told))
            columns.append(pa.array(np.where(chains.sound, chains.count, 0)))
            columns.append(pa.array(np.where(chains.sound, None, SHORT), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frames.select(*kept, "payload").mapInArrow(inspect, schema)


def decode_events(frames: DataFrame) -> DataFrame:
    """Batch frames to one row per event: the frame's other columns, ``idx, stream_id, timestamp_ns, is_stderr, payload,
    error``. A bad payload gives one row with the error and no event; bytes behind the last event are ignored.
    """
    kept = [c for c in frames.columns if c not in ("payload", "type", "stream_id", "event_count", "error")]
    added = [("idx", LongType()), ("stream_id", LongType()), ("timestamp_ns", LongType()),
             ("is_stderr", BooleanType()), ("payload", BinaryType()), ("error", StringType())]
    schema = StructType([frames.schema[c] for c in kept] + [StructField(*field) for field in added])

    def decode(batches):
        for batch in batches:
            chains = walked(batch.column("payload"))
            events, bad = events_of(chains), np.flatnonzero(~chains.sound)
            origin = pa.array(np.concatenate((chains.frame, bad)))
            ids = pa.array(chains.stream_id, mask=~chains.told).take(origin)
            none = lambda column: pa.concat_arrays([column, pa.nulls(len(bad), column.type)])
            columns = [*(batch.column(c).take(origin) for c in kept), none(pa.array(chains.number)), ids, *map(none, events)]
            columns.append(pa.concat_arrays([pa.nulls(len(chains.at), pa.string()), pa.array([SHORT] * len(bad), pa.string())]))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frames.select(*kept, "payload").mapInArrow(decode, schema)
