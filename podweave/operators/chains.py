"""The length chains of many batch payloads, walked together in numpy.

A payload is a stream id and a count, then so many events: 13 bytes of header, of which the last four are the length of
the bytes that follow. Where an event begins is known only from the one before, but the payloads of an Arrow batch are
independent: each step moves all of them one event on. Payloads that have many more events than the others would make
long steps of few, so the last ones are followed one by one.
"""

import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa

HEAD, EVENT = 8, 13

#: With fewer payloads left than this a step of all costs more than following each by itself.
TOGETHER = 24


class Chains(NamedTuple):
    """`data`: all bytes; of each payload `stream_id`, `count`, `told` (has a stream id) and `sound`; and of each event of
    the sound ones, in order, the payload it is of, its number there and the position of its header."""

    data: np.ndarray
    stream_id: np.ndarray
    count: np.ndarray
    told: np.ndarray
    sound: np.ndarray
    frame: np.ndarray
    number: np.ndarray
    at: np.ndarray


def _numbers(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Unsigned big-endian numbers of `width` bytes at the positions `at`."""
    if not len(at):
        return np.zeros(0, np.int64)
    # every position of the bytes as a number: a view, in which neighbours overlap
    return np.ndarray(len(data) - width + 1, f">u{width}", data, strides=(1,))[at].astype(np.int64)


def walked(payloads: pa.Array) -> Chains:
    """The chains of a binary column. A null, or a payload whose lengths lead out of it, is not sound; bytes behind the
    last event are ignored."""
    rows = len(payloads)
    _, ends, values = payloads.buffers()
    bounds = np.frombuffer(ends, np.int32, rows + 1, payloads.offset * 4).astype(np.int64) if rows else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    start, end = bounds[:-1], bounds[1:]
    told = (end - start >= HEAD) & payloads.is_valid().to_numpy(zero_copy_only=False)
    stream_id, count = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    stream_id[told], count[told] = _numbers(data, start[told], 4), _numbers(data, start[told] + 4, 4)
    sound, at, left = told.copy(), start + HEAD, count.copy()
    frames, places = [], []
    active = np.flatnonzero(told & (left > 0))
    while len(active) >= TOGETHER:
        whole = at[active] + EVENT <= end[active]
        sound[active[~whole]] = False
        active = active[whole]
        here = at[active]
        after = here + EVENT + _numbers(data, here + 9, 4)
        whole = after <= end[active]
        sound[active[~whole]] = False
        active, here, after = active[whole], here[whole], after[whole]
        frames.append(active)
        places.append(here)
        at[active] = after
        left[active] -= 1
        active = active[left[active] > 0]
    view, size = memoryview(data), struct.Struct(">I").unpack_from
    for one in active.tolist():
        here, last, found = int(at[one]), int(end[one]), []
        for _ in range(int(left[one])):
            if here + EVENT > last:
                break
            found.append(here)
            here += EVENT + size(view, here + 9)[0]
        sound[one] = len(found) == left[one] and here <= last
        frames.append(np.full(len(found), one, np.int64))
        places.append(np.array(found, np.int64))
    frame = np.concatenate(frames) if frames else np.zeros(0, np.int64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    kept = sound[frame]
    place = np.sort(place[kept])  # payloads lie behind one another, so this is the order of payload and event
    frame = np.searchsorted(start, place, "right") - 1
    number = np.arange(len(place)) - np.searchsorted(frame, frame)
    return Chains(data, stream_id, count, told, sound, frame, number, place)


class Events(NamedTuple):
    """Arrow columns of the events of `walked`."""

    timestamp_ns: pa.Array
    is_stderr: pa.Array
    payload: pa.Array


def events_of(chains: Chains) -> Events:
    """Timestamps, flags and bytes of all events; the bytes are one take from the column."""
    data, at = chains.data, chains.at
    # the bytes and the headers between them as one binary column over the same buffer, of which every other one is taken
    bounds = np.empty((len(at), 2), np.int32)
    bounds[:, 0] = at + EVENT
    bounds[:, 1] = bounds[:, 0] + _numbers(data, at + 9, 4)
    between = pa.Array.from_buffers(pa.binary(), max(2 * len(at) - 1, 0), [None, pa.py_buffer(bounds.ravel()), pa.py_buffer(data)])
    payload = between.take(pa.array(np.arange(0, 2 * len(at), 2)))
    # the flag's byte counts as set whatever its value but zero
    return Events(pa.array(_numbers(data, at, 8)), pa.array(data[at + 8] != 0), payload)
