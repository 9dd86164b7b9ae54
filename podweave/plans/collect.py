"""Collector side: lines of log files to events, batches and frames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podweave.functions.bytes import payload_bytes
from podweave.functions.rendering import is_stderr
from podweave.operators.batching import assign_batches, batch_pieces, batch_sizes, collect_batches
from podweave.operators.chunks import few_chunks, sparse_streams
from podweave.operators.frames import NAMES, encode_batches, encode_registry
from podweave.operators.parsing import parse_lines
from podweave.operators.registry import build_registry, join_registry


def collect_events(lines: DataFrame, formats=None) -> DataFrame:
    """Events with ``is_stderr`` and ``payload_bytes``. To be stored once: the steps behind read them several times,
    most of them only the narrow columns."""
    events = parse_lines(lines, **({"formats": formats} if formats else {}))
    return events.withColumns(
        {"is_stderr": is_stderr(F.col("stream")), "payload_bytes": payload_bytes(F.col("payload"))}
    ).drop("line")


def collect_frames(events: DataFrame, conn: str, seen: str, chunk: str = "chunk", order: str = "line_id",
                   delta: str | None = None) -> DataFrame:
    """Register and batch frames ``conn, seq, type, payload`` of the events of one collector.

    ``seen`` is a number that orders events over all files (an arrival number). A stream is registered when its first
    event is seen, a batch is sent when its last one is.
    """
    keys = ["path"] + ([delta] if delta else [])
    registry = build_registry(events, seen)
    registers = encode_registry(registry.select("stream_id", *NAMES, (2 * F.col("first_seen")).alias("seq")))
    # Streams of few rows are cut in one piece: summing up and seeding chunks of a few rows costs more than the cut.
    events = few_chunks(events, keys, chunk, sparse_streams(events, keys, chunk))
    pieces = batch_pieces(events, keys, chunk, order, "payload_bytes")
    assigned = assign_batches(events, pieces, keys, chunk, order)
    event = F.struct("timestamp_ns", "is_stderr", "payload", F.col(seen).alias("seen"))
    batches = join_registry(collect_batches(assigned, keys, order, event), registry)
    sent = F.transform("events", lambda e: F.struct(e["timestamp_ns"], e["is_stderr"], e["payload"]))
    batches = batches.select(
        "stream_id", (2 * F.array_max("events.seen") + 1).alias("seq"), "events"
    ).withColumn("events", sent)
    frames = registers.select("seq", "type", "payload").unionByName(encode_batches(batches).select("seq", "type", "payload"))
    return frames.withColumn("conn", F.lit(conn))


def collect_batch_table(events: DataFrame, chunk: str = "chunk", order: str = "line_id",
                        delta: str | None = None) -> DataFrame:
    """One row per batch with its size, without touching a payload."""
    keys = ["path"] + ([delta] if delta else [])
    slim = events.select(*keys, chunk, order, "payload_bytes")
    slim = few_chunks(slim, keys, chunk, sparse_streams(slim, keys, chunk))
    return batch_sizes(batch_pieces(slim, keys, chunk, order, "payload_bytes"), keys)
