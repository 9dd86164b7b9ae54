"""Token-bucket admission: a request (usually a batch, its cost the number of events) passes whole or not at all.

A bucket starts full, gains ``rate`` tokens per second up to ``burst``, keeps whole tokens only, and stays as it is on
a refusal. The clock is a column of the request in milliseconds, so a replay gives the same verdicts.
"""

import bisect
import math
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from podweave.operators.chunks import (
    few_chunks,
    in_chunks,
    in_frames,
    join_lookup,
    long_streams,
    runs,
    settle,
    sparse_streams,
    wide_chunks,
)
from podweave.settings import BURST, BURST_CEILING, CHUNK_ROWS, MOST_CHUNKS, RATE_PER_SECOND

STATE = ["_tokens", "_last"]
ENTRY = ["_from_tokens", "_from_last"]
TABLE = ["_full_tokens", "_full_last", "_first", "_low", "_starts", "_left", "_since", "_phase"]
# Kinds of ranges in a table, where a shift has its phase.
LANE, OPEN = -1, -2


def spend(state, costs, clocks, resets, rate: int, burst: int):
    """Verdicts of requests in order, and the state behind them. State is (tokens, last_ms), or None before the first.

    A reset row is no request: it gives a full bucket and has no verdict.
    """
    tokens, last = state if state is not None else (None, None)
    verdicts = []
    for cost, clock, reset in zip(costs, clocks, resets):
        if reset or tokens is None:
            tokens, last = burst, clock
        if reset:
            verdicts.append(None)
            continue
        available = int(min(burst, tokens + rate * max(0, clock - last) / 1000.0))
        admitted = cost <= available
        if admitted:
            tokens, last = available - cost, clock
        verdicts.append(admitted)
    return verdicts, None if tokens is None else (tokens, last)


def ceiled(burst: int) -> int:
    """The burst, or the ceiling with a warning."""
    if burst > BURST_CEILING:
        warnings.warn(f"a burst of {burst} is over the ceiling; {BURST_CEILING} is used", stacklevel=3)
    return min(burst, BURST_CEILING)


def admit(
    requests: DataFrame, keys: list[str], chunk: str, order: str, clock_ms: str, cost: str,
    rate: int = RATE_PER_SECOND, burst: int = BURST, reset: str | None = None, chunk_rows: int = CHUNK_ROWS,
    most_chunks: int = MOST_CHUNKS,
) -> DataFrame:
    """The requests with ``admitted BOOLEAN``; rows where ``reset`` is true refill the bucket and are not returned.

    The state at a chunk's start is that at the end of the chunk before. One pass over the slim columns tells, for each
    chunk, the end state by the start state, for all starts at once (``Outcomes``); the tables are followed along each
    stream, and a last pass judges every chunk from its true start. The input is read twice, however many chunks there
    are. Only where a chunk's clock lies behind an admission in an earlier chunk the table cannot tell; such chunks are
    folded again, one after the other. A stream of one chunk needs none of this, and one of up to ``chunk_rows`` rows is
    one chunk. In a stream of more than ``most_chunks`` chunks neighbours are joined to about that many.

    A request without clock or cost ends the job with an error. A burst over the ceiling is lowered to it, with a warning.
    """
    burst = ceiled(burst)
    is_reset = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    needed = lambda c: F.coalesce(F.col(c).cast("bigint"), F.raise_error(F.lit(f"a request has no {c}")).cast("bigint"))
    asked = {"_clock": needed(clock_ms), "_cost": F.when(is_reset, 0).otherwise(needed(cost)).cast("bigint")}
    group = [*keys, chunk]
    slim = settle(requests.select(*group, order, *(v.alias(k) for k, v in asked.items()), is_reset.alias("_reset")))
    sparse = sparse_streams(slim, keys, chunk, chunk_rows)
    rows, slim = (few_chunks(df, keys, chunk, sparse) for df in (requests.withColumn("_chunk", F.col(chunk)), slim))
    wide = wide_chunks(slim, keys, chunk, most_chunks)
    if wide is not None:
        rows, slim = (few_chunks(df, [*keys, chunk], chunk, wide) for df in (rows, slim))
    rows = rows.withColumns(asked | {
        "_reset": is_reset,
        "_seed": F.lit(False),
        "_tokens": F.lit(0).cast("bigint"),
        "_last": F.lit(0).cast("bigint"),
    })
    empty = {"_seed": F.lit(False), "_tokens": F.lit(0).cast("bigint"), "_last": F.lit(0).cast("bigint")}
    slim = slim.withColumns(empty)
    seeds = _start_states(slim, keys, chunk, order, rate, burst)
    if seeds is not None:
        rows = _with_seeds(rows, seeds, order)

    def judge(batches):
        state = (None, None)
        for batch in batches:
            frame = batch.select([*group, "_clock", "_cost", "_reset", "_seed", *STATE]).to_pandas()
            verdicts = []
            for found, _, state in _spent([frame], group, rate, burst, state):
                verdicts += found
            yield batch.append_column("admitted", pa.array(verdicts, pa.bool_()))

    schema = StructType([*rows.schema.fields, StructField("admitted", BooleanType())])
    judged = in_chunks(rows, keys, chunk, F.desc("_seed"), order).mapInArrow(judge, schema)
    judged = judged.where(~F.col("_seed") & ~F.col("_reset")).withColumn(chunk, F.col("_chunk"))
    return judged.select(*requests.columns, "admitted")


def _spent(frames, group, rate, burst, state=(None, None)):
    """Run by run: the verdicts (none for a seed row), the start state its seed row gives, and (key, end state)."""
    for key, run in runs(frames, group):
        bucket, seed, first = state[1] if state[0] == key else None, None, 0
        verdicts = []
        if run["_seed"][0]:
            bucket = seed = (int(run["_tokens"][0]), int(run["_last"][0]))
            verdicts, first = [None], 1
        more, bucket = spend(
            bucket, *(run[c][first:].tolist() for c in ("_cost", "_clock", "_reset")), rate, burst
        )
        state = (key, bucket)
        yield verdicts + more, seed, state


def _with_seeds(rows: DataFrame, seeds: DataFrame, order: str) -> DataFrame:
    added = seeds.withColumns({
        "_seed": F.lit(True), "_reset": F.lit(False), order: F.lit(0).cast(rows.schema[order].dataType),
        "_clock": F.lit(0).cast("bigint"), "_cost": F.lit(0).cast("bigint"),
    })
    return rows.unionByName(added, allowMissingColumns=True)


class Outcomes:
    """What a run of requests makes of every state a bucket may have before it.

    Up to the first request that is admitted, or a reset, a state counts only by x, the thousandths of tokens there at the
    first request's time, from 0 to the full bucket. ``open`` is the number of x, from 0 on, that have seen neither. All
    others lie in ranges of x, and a range belongs to a *group*: neighbouring numbers of tokens (``least`` and up, ``width``
    of them) with one time of the last admission. All states of a group have seen the same verdicts. A request moves a
    group as a whole; it is cut only where its lower part is refused or its upper part finds the bucket full, and what was
    full is one state. Groups that come to agree are one, whatever ranges they have. So a row costs a few groups, however
    large the burst is.
    """

    MERGE = 64  # rows between two looks for groups that have met, or new groups, at least

    def __init__(self, rate: int, burst: int):
        self.rate, self.burst = rate, burst
        self.full = None  # the end state of a bucket that is new here
        self.first, self.low, self.open = None, None, 1000 * burst + 1
        self.seen = self.known = 0  # rows since the last merge, and groups it left
        self.least = self.width = self.last = np.zeros(0, np.int64)
        self.fresh: list[tuple[int, int, int]] = []  # groups behind those of the arrays
        self.parts: dict[int, list[tuple[int, int]]] = {}  # of groups that were cut: first entry and group of each part
        # Ranges: lower end, group, and phase; x is entry (x + phase) // 1000 of the group, if that has more than one.
        self.starts = self.groups = self.phases = np.zeros(0, np.int64)
        self.ranges: list[tuple[int, int, int]] = []  # behind those of the arrays

    def add(self, costs, clocks, resets) -> None:
        _, self.full = spend(self.full, costs, clocks, resets, self.rate, self.burst)
        for cost, clock, reset in zip(costs, clocks, resets):
            self.first = clock if self.first is None else self.first
            if reset:
                self.least, self.width, self.last = np.array([self.burst]), np.array([1]), np.array([clock])
                self.starts = self.groups = self.phases = np.zeros(1, np.int64)
                self.open, self.fresh, self.parts, self.ranges = 0, [], {}, []
                continue
            if len(self.least) == 1 and not self.open and not self.fresh and self.width[0] == 1:
                tokens, last = int(self.least[0]), int(self.last[0])
                level = min(self.burst, tokens + self.rate * max(0, clock - last) // 1000)
                if cost <= level:
                    self.least[0], self.last[0] = level - cost, clock
                continue
            if cost <= self.burst:
                self._settle()
                if len(self.least):
                    self._spend(cost, clock)
            if self.open:
                self.low = clock if self.low is None else min(self.low, clock)
                if cost <= self.burst:
                    self._admit_open(cost, clock)
            self.seen += 1
            # many ranges make a look dear, many groups make it worth while
            if self.seen >= self.MERGE + len(self.starts) // 16 or len(self.least) > self.MERGE + 2 * self.known:
                self._merge()

    def _spend(self, cost: int, clock: int) -> None:
        level = self.least + self.rate * np.maximum(0, clock - self.last) // 1000
        passing = np.minimum(np.maximum(cost - level, 0), self.width)  # entries below are refused
        filled = np.minimum(np.maximum(self.burst - level, passing), self.width)  # entries from here on are full
        cut = (passing > 0) & (passing < self.width) | (passing == 0) & (filled > 0) & (filled < self.width)
        for i in np.flatnonzero(cut).tolist():
            a, b, width = int(passing[i]), int(filled[i]), int(self.width[i])
            parts = [(0, a, int(self.least[i]), int(self.last[i])), (a, b - a, int(level[i]) + a - cost, clock)]
            if b < width:
                parts.append((b, 1, self.burst - cost, clock))
            self.parts[i] = [(at, self._group(least, size, last)) for at, size, least, last in parts if size]
        moved = (passing == 0) & ~cut
        full = moved & (filled == 0) & (self.width > 0)
        self.least = np.where(full, self.burst - cost, np.where(moved, level - cost, self.least))
        self.last = np.where(moved, clock, self.last)
        self.width = np.where(cut, 0, np.where(full, 1, self.width))

    def _admit_open(self, cost: int, clock: int) -> None:
        grown = self.rate * (clock - self.first)
        low = min(max(0, 1000 * cost - grown), self.open)
        high = min(max(1000 * self.burst - grown, low), self.open)
        if low < high:
            level = (low + grown) // 1000
            group = self._group(level - cost, (high - 1 + grown) // 1000 - level + 1, clock)
            self.ranges.append((low, group, grown - 1000 * level))
        if high < self.open:
            self.ranges.append((high, self._group(self.burst - cost, 1, clock), 0))
        self.open = low

    def _group(self, least: int, width: int, last: int) -> int:
        if width > 1 or not self.fresh or self.fresh[-1] != (least, width, last):
            self.fresh.append((least, width, last))
        return len(self.least) + len(self.fresh) - 1

    def _settle(self) -> None:
        if self.fresh:
            least, width, last = np.array(self.fresh, np.int64).T
            self.least, self.width, self.last = np.append(self.least, least), np.append(self.width, width), np.append(self.last, last)
            self.fresh = []

    def _merge(self) -> None:
        """Ranges of the groups there are now; groups that agree become one, and so do ranges that go on in each other."""
        self._settle()
        starts, groups, phases = (np.append(known, np.array([r[k] for r in self.ranges], np.int64))
                                  for k, known in enumerate((self.starts, self.groups, self.phases)))
        self.ranges, self.seen = [], 0
        if not len(starts):
            return
        while self.parts and (cut := self.width[groups] == 0).any():
            rows = [(max(start, 1000 * at - phase) if at else start, part, phase - 1000 * at)
                    for start, group, phase in zip(*(a[cut].tolist() for a in (starts, groups, phases))) for at, part in self.parts[group]]
            starts, groups, phases = (np.append(a[~cut], b) for a, b in zip((starts, groups, phases), np.array(rows, np.int64).T))
        self.parts = {}
        order = np.argsort(starts, kind="stable")
        starts, groups, phases = starts[order], groups[order], phases[order]
        live, groups = np.unique(groups, return_inverse=True)
        states = np.stack((self.last[live], self.least[live], self.width[live]))
        states, same = np.unique(states, axis=1, return_inverse=True)
        groups = same.ravel()[groups]
        last, least, width = states
        # a range goes on in the next if that is the same single state, or the next numbers of tokens
        ends = np.append(starts[1:], 1000 * self.burst + 1)
        one, base = width[groups] == 1, 1000 * least[groups] + phases
        true = ((ends - 1 + phases) // 1000 + 1 == width[groups]) & (np.bincount(groups, minlength=len(last))[groups] == 1)
        on = (groups[1:] == groups[:-1]) & one[1:]
        grows = ~on & true[1:] & true[:-1] & (base[1:] == base[:-1]) & (last[groups[1:]] == last[groups[:-1]])
        kept = np.append(True, ~(on | grows))
        for i in np.flatnonzero(grows & kept[:-1]).tolist():
            end = i + 1
            while end < len(grows) and grows[end]:
                end += 1
            width[groups[i]] = (ends[end] - 1 + phases[i]) // 1000 + 1
        starts, groups, phases = starts[kept], groups[kept], phases[kept]
        live, groups = np.unique(groups, return_inverse=True)
        self.last, self.least, self.width = last[live], least[live], width[live]
        self.starts, self.groups, self.phases = starts, groups.ravel(), phases
        self.known = len(live)

    def table(self) -> tuple:
        """(end state of a new bucket; first clock, least clock met by an untouched state; then ranges of x: lower ends,
        tokens, last times, and phases: LANE for one state, OPEN for a state that stays as it is, or what is added to x
        before it is divided by 1000 and added to the tokens)."""
        self._merge()
        least, one = self.least[self.groups], self.width[self.groups] == 1
        columns = (self.starts, np.where(one, least, least + self.phases // 1000), self.last[self.groups],
                   np.where(one, LANE, self.phases % 1000))
        rows = list(zip(*(c.tolist() for c in columns)))
        return *self.full, self.first, self.low, *map(list, zip(*([(0, 0, 0, OPEN)] if self.open else []), *rows))


def outcome(state, table, rate: int, burst: int):
    """The state behind a run, by its table; None where a clock that goes back keeps the table from telling."""
    *full, first, low, starts, tokens, last, phases = table
    if state == (-1, -1):
        return tuple(map(int, full))
    if low is not None and not math.isnan(low) and low < state[1]:
        return None
    x = 1000 * state[0] + rate * (first - state[1]) if first >= state[1] else 0
    if x > 1000 * burst and low is not None and low < first:
        return None  # the clock went back: how full the bucket was before counts
    x = min(x, 1000 * burst)
    at = bisect.bisect_right(starts, x) - 1
    if phases[at] == OPEN:
        return state
    return int(tokens[at] if phases[at] == LANE else (x + phases[at]) // 1000 + tokens[at]), int(last[at])


def _in_light_frames(rows, columns, entries: int = 1 << 16):
    """Tables packed into frames of about so many ranges: a table may have few or very many."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + len(row[-1])
        if weight >= entries:
            yield pd.DataFrame(held, columns=columns)
            held, weight = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _start_states(slim: DataFrame, keys, chunk, order, rate: int, burst: int) -> DataFrame | None:
    """``keys, chunk, _tokens, _last`` at the start of every chunk but a stream's first; None when all have one."""
    group = [*keys, chunk]
    several = long_streams(slim, keys, chunk)
    if several.isEmpty():
        return None
    slim = join_lookup(slim, several, keys, "left_semi")
    fields = [slim.schema[c] for c in group]
    per_chunk = [*group, *TABLE]
    lists = [StructField(c, ArrayType(LongType())) for c in TABLE[4:]]
    longs = lambda names: [StructField(c, LongType()) for c in names]

    def tabulate(frames):
        key, made = None, None
        for next_key, run in runs(frames, group):
            if next_key != key:
                if key is not None:
                    yield (*key, *made.table())
                key, made = next_key, Outcomes(rate, burst)
            made.add(*(run[c].tolist() for c in ("_cost", "_clock", "_reset")))
        if key is not None:
            yield (*key, *made.table())

    def fold(rows: DataFrame) -> DataFrame:
        def end_states(frames):
            """One row per chunk: the state it started from and the one it ended in."""
            key, entry, end = None, None, None
            for _, seed, (run_key, bucket) in _spent(frames, group, rate, burst):
                if run_key != key:
                    if key is not None:
                        yield (*key, *entry, *end)
                    key, entry = run_key, seed
                end = bucket
            if key is not None:
                yield (*key, *entry, *end)

        return in_chunks(rows, keys, chunk, F.desc("_seed"), order).mapInPandas(
            lambda frames: in_frames(end_states(frames), [*group, *ENTRY, *STATE]), StructType(fields + longs((*ENTRY, *STATE)))
        )

    def follow(frames):
        """Through a stream's chunks in order: each one's start state, and whether its end is known for that start."""
        stream, state = None, None
        for frame in frames:
            columns = [frame[c].tolist() for c in (*per_chunk, "_ends")]
            for *row, ends in zip(*columns):
                key, table = row[:len(group)], row[len(group):]
                started = state if key[:-1] == stream else None
                if started is None:
                    stream, state = key[:-1], (-1, -1)
                found = {(e["_from_tokens"], e["_from_last"]): (e["_tokens"], e["_last"]) for e in (() if ends is None else ends)}
                end = outcome(state, table, rate, burst) or found.get(state)
                if started is not None:
                    yield (*key, *started, end is not None)
                # Without an end the stream is followed from a guess, and looked at again once the chunk has been folded.
                state = end if end is not None else state

    found_columns = [*group, *STATE, "_known"]
    found_schema = StructType(fields + longs(STATE) + [StructField("_known", BooleanType())])
    # One table per chunk: a stream's tables pass one task, its requests do not.
    tables = settle(in_chunks(slim, keys, chunk, order).mapInPandas(
        lambda frames: _in_light_frames(tabulate(frames), per_chunk), StructType(fields + longs(TABLE[:4]) + lists)
    ))
    entry = F.struct(*ENTRY, *STATE)
    ends = None
    while True:
        known = tables.withColumn("_ends", F.lit(None).cast(f"array<struct<{', '.join(f'{c}: bigint' for c in (*ENTRY, *STATE))}>>"))
        if ends is not None:
            known = tables.join(ends.groupBy(*group).agg(F.collect_list(entry).alias("_ends")), group, "left")
        ordered = known.repartition(*keys).sortWithinPartitions(*keys, chunk)
        found = settle(ordered.mapInPandas(lambda frames: in_frames(follow(frames), found_columns), found_schema))
        open_chunks = found.where("NOT _known").drop("_known")
        if open_chunks.isEmpty():
            return found.drop("_known")
        again = join_lookup(slim, open_chunks.select(*group), group, "left_semi")
        more = fold(_with_seeds(again, open_chunks, order))
        ends = settle(more if ends is None else ends.unionByName(more))
