"""Texts as numpy arrays: code points, words and hashed word shingles, whole batches at a time."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about this many characters (a longer text is a piece by itself), which bounds memory.
PIECE = 1 << 18

_POWER = 0x9E3779B97F4A7C15 | 1


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@functools.cache
def _characters(fold: bool) -> np.ndarray:
    """A random 64-bit number for each code point; with `fold` the same one for A-Z and a-z."""
    table = mixed(np.arange(0x110000))
    if fold:
        table[65:91] = table[97:123]
    return table


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_POWER, -1, 1 << 64)
    return tuple(np.concatenate(([np.uint64(1)], np.full(size - 1, base, np.uint64))).cumprod(dtype=np.uint64)
                 for base in (np.uint64(_POWER), np.uint64(inverse)))


def pieces(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts): consecutive texts of about `most` characters together; null is empty."""
    begun, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > most:
            yield begun, held
            begun, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield begun, held


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a line feed between them, and where each text starts (one more entry at the end)."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return points, starts


def slice_hashes(points: np.ndarray, gap: np.ndarray, starts: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of the slices that begin at `starts` and reach to the next; positions marked in `gap` don't count."""
    power, inverse = _powers(1 << max(18, int(len(points)).bit_length()))
    values = _characters(fold)[points] * power[: len(points)]
    values[gap] = 0
    return mixed(np.add.reduceat(values, starts) * inverse[starts])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` without regard to ASCII case; the word at which each text
    starts (one more entry at the end); and each word's first position in the joined code points."""
    points, at = codepoints(texts)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    gap = (points == 32) | ((points >= 9) & (points <= 13))
    begins = ~gap
    begins[1:] &= gap[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), starts
    return slice_hashes(points, gap, starts, True), np.searchsorted(starts, at), starts


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its windows of `width` words; a text of fewer words is one window, of none nothing."""
    factors = mixed(np.arange(1, width + 1)) | np.uint64(1)
    windows = max(0, len(hashes) - width + 1)
    total = np.zeros(windows, np.uint64)
    for j in range(width):
        total += hashes[j: j + windows] * factors[j]
    total = mixed(total)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield total[a: b - width + 1]
        elif b > a:
            yield mixed(np.array([np.sum(hashes[a:b] * factors[: b - a]) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the integer columns `keys`, across batches; the rows must come sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(column[a] for column in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def packed(arrays: list[np.ndarray]) -> pa.Array:
    """64-bit numbers as one Arrow list<int64> column."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
