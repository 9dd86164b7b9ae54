"""The chunked cut against a plain loop, over chunks and Arrow batches far smaller than a batch."""

import random

import pytest
from pyspark.sql import functions as F

from podweave.operators.batching import assign_batches, batch_pieces, batch_sizes, collect_batches
from podweave.operators.chunks import add_chunk


def cut_in_order(rows, max_events, max_bytes):
    """(stream, order) -> batch number."""
    found, state = {}, {}
    for stream, order, size in sorted(rows):
        batch, count, total = state.get(stream, (0, 0, 0))
        found[stream, order] = batch
        count, total = count + 1, total + size
        state[stream] = (batch + 1, 0, 0) if count >= max_events or total >= max_bytes else (batch, count, total)
    return found


def some_rows(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for stream, n in (("hot", 700), ("warm", 90), ("one", 1), ("two", 2)):
        order = 0
        for _ in range(n):
            order += rng.choice([1, 1, 1, 2, 9])
            rows.append((stream, order, sizes(rng)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [3, 20, 100, 10**6])
@pytest.mark.parametrize("name, sizes", [
    ("count", lambda r: r.randint(0, 3)),
    ("bytes", lambda r: r.choice([1, 5, 30, 60, 150])),
    ("zero", lambda r: 0),
])
def test_chunks_do_not_change_the_cut(spark, span, name, sizes):
    rows = some_rows(span, sizes)
    max_events, max_bytes = 8, 100
    expected = cut_in_order(rows, max_events, max_bytes)
    events = add_chunk(spark.createDataFrame(rows, "stream string, at bigint, size bigint"), "at", span)
    pieces = batch_pieces(events, ["stream"], "chunk", "at", "size", max_events, max_bytes)
    assigned = assign_batches(events, pieces, ["stream"], "chunk", "at")
    got = {(r.stream, r.at): r.batch_id for r in assigned.collect()}
    assert got == expected
    sizes_of = {(r.stream, r.batch_id): (r.event_count, r.payload_bytes, r.first_order, r.last_order)
                for r in batch_sizes(pieces, ["stream"]).collect()}
    want = {}
    for stream, at, size in sorted(rows):
        n, total, first, _ = want.get((stream, expected[stream, at]), (0, 0, at, at))
        want[stream, expected[stream, at]] = (n + 1, total + size, first, at)
    assert sizes_of == want
    collected = collect_batches(assigned, ["stream"], "at", F.struct("at", "size"))
    got = {(r.stream, r.batch_id): [(e["at"], e["size"]) for e in r.events] for r in collected.collect()}
    want = {}
    for stream, at, size in sorted(rows):
        want.setdefault((stream, expected[stream, at]), []).append((at, size))
    assert got == want


def test_payloads_are_shuffled_once(spark):
    """Plan of assignment and collection: one exchange of the events, none between the window and the grouping."""
    events = add_chunk(spark.createDataFrame(some_rows(1, lambda r: 9), "stream string, at bigint, size bigint"), "at", 20)
    pieces = batch_pieces(events, ["stream"], "chunk", "at", "size", 8, 100)
    assigned = assign_batches(events, pieces, ["stream"], "chunk", "at")
    batches = collect_batches(assigned, ["stream"], "at", F.struct("at", "size"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = batches._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    before_window = plan[: plan.index("Window")]
    assert "Exchange hashpartitioning" not in before_window


def test_a_read_end_closes_the_batch(spark):
    rows = [("s", delta, at, 1) for at, delta in enumerate([0, 0, 0, 1, 1, 1, 1, 1, 2])]
    events = add_chunk(spark.createDataFrame(rows, "stream string, delta bigint, at bigint, size bigint"), "at", 2)
    pieces = batch_pieces(events, ["stream", "delta"], "chunk", "at", "size", 3, 1000)
    got = sorted((r.delta, r.batch_id, r.event_count) for r in batch_sizes(pieces, ["stream", "delta"]).collect())
    assert got == [(0, 0, 3), (1, 0, 3), (1, 1, 2), (2, 0, 1)]


def test_default_limits(spark):
    """64 events close a batch; so do 56 KiB, counted with the event that reaches them."""
    rows = [("count", i, 1) for i in range(130)] + [("bytes", i, 57_343 if i == 0 else 1) for i in range(4)]
    events = add_chunk(spark.createDataFrame(rows, "stream string, at bigint, size bigint"), "at")
    got = sorted((r.stream, r.batch_id, r.event_count, r.payload_bytes) for r in batch_sizes(
        batch_pieces(events, ["stream"], "chunk", "at", "size"), ["stream"]).collect())
    assert got == [("bytes", 0, 2, 57_344), ("bytes", 1, 2, 2),
                   ("count", 0, 64, 64), ("count", 1, 64, 64), ("count", 2, 2, 2)]
