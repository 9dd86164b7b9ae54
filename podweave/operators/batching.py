"""Greedy batches per stream: a batch closes when it holds 64 events or 56 KiB *after* the event just added, and at
the end of each read (``delta``, one of the keys).

``batch_pieces`` works on keys, order and size only. A batch that goes over a chunk's end comes as several pieces.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from podweave.operators.chunks import in_chunks, in_frames, join_lookup, long_streams, runs, settle
from podweave.settings import BATCH_MAX_BYTES, BATCH_MAX_EVENTS

LANE_LISTS = ["head", "closed", "counts", "sizes"]
SEED = ["_batch", "_home", "_count", "_size"]
PIECE = ["home_chunk", "batch_id", "first_order", "last_order", "event_count", "payload_bytes"]


def _schema(df: DataFrame, columns: list[str], longs: list[str], lists: list[str] = ()) -> StructType:
    added = [StructField(n, LongType()) for n in longs] + [StructField(n, ArrayType(LongType())) for n in lists]
    return StructType([df.schema[c] for c in columns] + added)


def _closing_rows(sizes: np.ndarray, max_events: int, max_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Running bytes; and for a batch starting at each row, the row behind its last (past the end: still open)."""
    total = np.cumsum(sizes)
    by_bytes = np.searchsorted(total, total - sizes + max_bytes) + 1
    by_bytes[by_bytes > len(sizes)] = len(sizes) + max_events
    return total, np.minimum(np.arange(len(sizes)) + max_events, by_bytes)


class Lanes:
    """What a chunk does for every possible start: lane s is the chunk with its first batch starting at row s."""

    def __init__(self, max_events: int, max_bytes: int):
        self.max_events, self.max_bytes = max_events, max_bytes
        self.rows = 0
        self.head: list[int] = []
        lane = np.arange(max_events)
        # Lane s > 0 acts as if max_events - s events of no size were open: it closes exactly before row s.
        self.count = np.where(lane > 0, max_events - lane, 0)
        self.bytes = np.where(lane > 0, -(2**62), 0)
        self.closed = np.where(lane > 0, -1, 0)

    def add(self, sizes: np.ndarray) -> None:
        n = len(sizes)
        self.rows += n
        self.head += sizes[: self.max_events - len(self.head)].tolist()
        total, closing = _closing_rows(sizes, self.max_events, self.max_bytes)
        sums = np.concatenate([[0], total])
        by_bytes = np.searchsorted(total, self.max_bytes - self.bytes) + 1
        row = np.where(self.count > 0, np.minimum(self.max_events - self.count, by_bytes), closing[0])
        start = np.zeros(self.max_events, dtype=np.int64)
        moved = live = row <= n
        while live.any():
            self.closed[live] += 1
            start[live] = row[live]
            live = live & (start < n)
            row[live] = closing[start[live]]
            live = live & (row <= n)
        self.count = np.where(moved, n - start, self.count + n)
        self.bytes = np.where(moved, sums[n] - sums[start], self.bytes + sums[n])

    def lists(self) -> list[list[int]]:
        used = min(self.max_events, self.rows)
        return [self.head, *(a[:used].tolist() for a in (self.closed, self.count, self.bytes))]


def batch_pieces(
    events: DataFrame, keys: list[str], chunk: str, order: str, size: str,
    max_events: int = BATCH_MAX_EVENTS, max_bytes: int = BATCH_MAX_BYTES,
) -> DataFrame:
    """``keys, chunk, home_chunk, batch_id, first_order, last_order, event_count, payload_bytes``.

    Batch ids count from 0 in each key; ``home_chunk`` is the chunk in which the batch began.

    A greedy cut depends on all rows before it, but only through the one batch open at a chunk's start, whose first
    event lies at most ``max_events`` rows back. So a chunk is summed up for each of those starts, the summaries are
    followed along the stream, and each chunk is then cut with the true open batch as its seed.
    """
    group = [*keys, chunk]
    slim = events.select(*group, order, F.col(size).cast("bigint").alias("_size"))
    rows = slim.withColumns({"_seed": F.lit(0)} | {c: F.lit(0).cast("bigint") for c in SEED if c != "_size"})
    several = long_streams(slim, keys, chunk)
    if not several.isEmpty():
        seeds = _seeds(join_lookup(slim, several, keys, "left_semi"), keys, chunk, order, max_events, max_bytes)
        rows = rows.unionByName(seeds.withColumns({"_seed": F.lit(1), order: F.lit(0).cast("bigint")}))

    def cut(frames):
        state = (None, None)
        for key, run in runs(frames, group):
            if state[0] != key:
                state = (key, (0, key[-1], 0, 0))
            sizes, orders = run["_size"], run[order]
            if run["_seed"][0] == 1:
                state = (key, tuple(int(run[c][0]) for c in SEED))
                sizes, orders = sizes[1:], orders[1:]
            n = len(sizes)
            if n == 0:
                continue
            batch, home, count, size_sum = state[1]
            total, closing = _closing_rows(sizes, max_events, max_bytes)
            steps = closing.tolist()
            at = min(max_events - count, int(np.searchsorted(total, max_bytes - size_sum)) + 1)
            starts = [0]
            while at < n:
                starts.append(at)
                at = steps[at]
            bounds = np.array([*starts, n])
            sums = np.concatenate([[0], total])
            homes = [home if count > 0 else key[-1]] + [key[-1]] * (len(starts) - 1)
            pieces = zip(homes, range(batch, batch + len(starts)), orders[bounds[:-1]], orders[bounds[1:] - 1],
                         np.diff(bounds), np.diff(sums[bounds]))
            for piece in pieces:
                yield (*key, *piece)
            last, only = batch + len(starts) - 1, len(starts) == 1
            open_count = n - starts[-1] + (count if only else 0)
            open_size = int(sums[n] - sums[starts[-1]]) + (size_sum if only else 0)
            if open_count >= max_events or open_size >= max_bytes:
                state = (key, (last + 1, key[-1], 0, 0))
            else:
                state = (key, (last, homes[-1], open_count, open_size))

    ordered = in_chunks(rows, keys, chunk, F.desc("_seed"), order)
    return ordered.mapInPandas(
        lambda frames: in_frames(cut(frames), [*group, *PIECE]), _schema(slim, group, PIECE)
    )


def _seeds(slim: DataFrame, keys, chunk, order, max_events: int, max_bytes: int) -> DataFrame:
    """The batch open at the start of every chunk but a stream's first: its number, home chunk, events and bytes."""
    group = [*keys, chunk]
    per_chunk = [*group, "rows", *LANE_LISTS]

    def summarise(frames):
        key, lanes = None, None
        for next_key, run in runs(frames, group):
            if next_key != key:
                if key is not None:
                    yield (*key, lanes.rows, *lanes.lists())
                key, lanes = next_key, Lanes(max_events, max_bytes)
            lanes.add(run["_size"])
        if key is not None:
            yield (*key, lanes.rows, *lanes.lists())

    def follow(frames):
        stream = None
        for frame in frames:
            for *key, rows, head, closed, counts, sizes in zip(*(frame[c].tolist() for c in per_chunk)):
                if key[:-1] != stream:
                    stream, batch, home, count, size = key[:-1], 0, None, 0, 0
                else:
                    yield (*key, batch, key[-1] if count == 0 else home, count, size)
                head = np.cumsum(head)
                start = 0 if count == 0 else min(max_events - count, int(np.searchsorted(head, max_bytes - size)) + 1)
                if start > rows:
                    count, size = count + rows, size + int(head[-1])
                elif start == rows:
                    batch, count, size = batch + 1, 0, 0
                else:
                    # With nothing left open at the end, the closed count has gone past the last batch already.
                    batch += int(closed[start]) + (1 if count > 0 else 0)
                    home, count, size = key[-1], int(counts[start]), int(sizes[start])

    summaries = in_chunks(slim, keys, chunk, order).mapInPandas(
        lambda frames: in_frames(summarise(frames), per_chunk), _schema(slim, group, ["rows"], LANE_LISTS)
    )
    ordered = summaries.repartition(*keys).sortWithinPartitions(*keys, chunk)
    return ordered.mapInPandas(
        lambda frames: in_frames(follow(frames), [*group, *SEED]), _schema(slim, group, SEED)
    )


def batch_sizes(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per batch: ``keys, batch_id, first_order, last_order, event_count, payload_bytes``."""
    return pieces.groupBy(*keys, "batch_id").agg(
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.sum("event_count").alias("event_count"),
        F.sum("payload_bytes").alias("payload_bytes"),
    )


def assign_batches(events: DataFrame, pieces: DataFrame, keys: list[str], chunk: str, order: str) -> DataFrame:
    """Events with ``home_chunk`` and ``batch_id``, partitioned by (keys, home_chunk), where each batch is whole.

    The few events at a chunk's start that belong to a batch begun before go to that batch's chunk first, so that the
    payloads are shuffled once, for the assignment and for a grouping into batches together.
    """
    pieces = settle(pieces)
    crossing = pieces.where(F.col("home_chunk") != F.col(chunk)).groupBy(*keys, chunk).agg(
        F.max("last_order").alias("_until"), F.max("home_chunk").alias("_home")
    )
    homed = join_lookup(events, crossing, [*keys, chunk], "left")
    home = F.when(F.col(order) <= F.col("_until"), F.col("_home")).otherwise(F.col(chunk))
    homed = homed.withColumn("home_chunk", home).drop("_until", "_home")
    starts = pieces.select(*keys, "home_chunk", F.col("first_order").alias(order), F.col("batch_id").alias("_batch"))
    merged = homed.withColumn("_event", F.lit(1)).unionByName(
        starts.withColumn("_event", F.lit(0)), allowMissingColumns=True
    )
    so_far = Window.partitionBy(*keys, "home_chunk").orderBy(order, "_event")
    labelled = merged.withColumn("batch_id", F.last("_batch", ignorenulls=True).over(so_far))
    return labelled.where("_event = 1").drop("_event", "_batch")


def collect_batches(assigned: DataFrame, keys: list[str], order: str, event: Column) -> DataFrame:
    """One row per batch with its events as an ordered array; a group holds one batch, so it is small.

    Takes the result of ``assign_batches`` and needs no further shuffle.
    """
    numbered = F.struct(F.col(order).alias("at"), event.alias("event"))
    grouped = assigned.groupBy(*keys, "home_chunk", "batch_id").agg(F.sort_array(F.collect_list(numbered)).alias("_in"))
    return grouped.select(
        *keys, "batch_id", F.size("_in").cast("bigint").alias("event_count"), F.col("_in.event").alias("events")
    )
