"""Repeated passages: runs of `length` words and more that occur again, wherever they begin and whatever lines they cross.

Winnowing finds them. Of the hashes of all windows of half the length, the least of each stretch is kept, where a stretch
is all such windows in `length` words: two runs of the same words keep the same hashes, whatever surrounds them. Only
around kept hashes that occur twice are the windows of the full length looked at, and there all of them, each by its own
64-bit hash. A document whose words are all those of another is told by its whole and takes no part in this.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podweave.llm.landing import dropped, in_arrow, landed
from podweave.llm.sieve import repeated_hashes, short, sieve, sifted, told, without
from podweave.llm.textarrays import _powers, mixed, pieces, word_hashes

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run_hashes(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of words [begin, end), which may overlap; equal words hash alike at any place."""
    power, inverse = _powers(1 << max(18, int(len(hashes)).bit_length()))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * inverse[begins])


def _slid(function: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The function's value over each stretch of `width` values."""
    have = 1
    while 2 * have <= width:
        values = function(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return function(values[:-rest], values[rest:]) if rest else values


def winnowed(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the kept windows of half the length; every run of `length` words of one text holds one.

    Of equal least hashes all are kept, so that what is kept of a run doesn't depend on what is around it."""
    half, n = length // 2, len(hashes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stretch = length - half + 1
    at = np.arange(n - half + 1)
    grams = run_hashes(hashes, at, at + half)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    least = np.where(owner[: n - length + 1] == owner[length - 1:], _slid(np.minimum, grams, stretch), np.uint64(0))
    around = np.zeros(stretch - 1, np.uint64)
    most = _slid(np.maximum, np.concatenate((around, least, around)), stretch)
    kept = np.flatnonzero((most == grams) & (most > 0))
    return kept, grams[kept]


def _numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    """A row's list of numbers; as Python objects the lists of a batch would take ten times their size."""
    return batch.column(column)[row].values.to_numpy().astype(np.int64)


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """key, text_hash, pos, f: the windows of `length` words that hold a hash at one of `spots` (rows key, text_hash, text, spots)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in pieces(batch.column("text").to_pylist()):
                hashes, first, _ = word_hashes(texts)
                change = np.zeros(len(hashes) + 1, np.int64)
                for k in range(len(texts)):
                    last = first[k + 1] - length
                    spot = _numbers(batch, "spots", begun + k) + first[k]
                    np.add.at(change, np.maximum(spot - (length - length // 2), first[k]), 1)
                    np.add.at(change, np.minimum(spot, last) + 1, -1)
                at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                owner = np.searchsorted(first, at, "right") - 1
                part = batch.slice(begun, len(texts))
                own = [part.column(x).take(pa.array(owner)) for x in ("key", "text_hash")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(at - first[owner], pa.int32()), pa.array(run_hashes(hashes, at, at + length).view(np.int64))],
                    ["key", "text_hash", "pos", "f"])

    kind = rows.schema["key"].dataType.simpleString()
    return in_arrow(rows, windows, f"key {kind}, text_hash long, pos int, f long")


def _spans(rows: DataFrame, length: int) -> DataFrame:
    """key, text_hash, doc, begin, words, taken (lines of which no word is left), others: one row for each stretch of words
    under the windows at `at`, of all words if that is null."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, begin, size, taken = [], [], [], []
            for k, n in enumerate(batch.column("n").to_pylist()):
                lines, starts = (_numbers(batch, x, k) for x in ("lines", "starts"))
                if not batch.column("at")[k].is_valid:
                    found = [(0, n)]
                else:
                    at = np.sort(_numbers(batch, "at", k))
                    cut = np.flatnonzero(np.diff(at) > length) + 1
                    found = zip(at[np.append(0, cut)].tolist(), (at[np.append(cut, len(at)) - 1] + length).tolist(), strict=True)
                edges = np.append(starts, n)
                for a, b in found:
                    low, high = np.searchsorted(edges, a), np.searchsorted(edges, b, "right") - 1
                    owner.append(k)
                    begin.append(a)
                    size.append(b - a)
                    taken.append(lines[low: max(low, high)])
            own = [batch.column(x).take(pa.array(owner, pa.int64())) for x in ("key", "text_hash", "doc", "others")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(taken, pa.list_(pa.int64()))],
                ["key", "text_hash", "doc", "others", "begin", "words", "taken"])

    kind = rows.schema["key"].dataType.simpleString()
    return in_arrow(rows, spans, f"key {kind}, text_hash long, doc long, others array<{kind}>, begin long, words long, taken array<long>")


def _next_to(x: Column, i: Column) -> Column:
    """Whether the hash before or after is among those of the text's list `near`."""
    before, after = F.get("near", i - 1)["nth"], F.get("near", i + 1)["nth"]
    return F.coalesce(before == x["nth"] - 1, F.lit(False)) | F.coalesce(after == x["nth"] + 1, F.lit(False))


def _passed(kept: DataFrame, twice: DataFrame) -> DataFrame:
    """key, text_hash, near (array of nth, spot, print, in order): the kept hashes that two sieves of `twice` let through."""
    near = sifted(kept, F.col("print"), sieve(twice, "hash")).where("_may").drop("_may")
    second = sieve(twice.select(F.xxhash64("hash").alias("hashed")), "hashed")
    near = sifted(near, F.xxhash64("print"), second).where("_may")
    return near.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set(F.struct("nth", "spot", "print"))).alias("near"))


def _lone(texts: DataFrame) -> DataFrame:
    """key, text_hash, spot, hash of the hashes in `near` that are next to no other."""
    return texts.select("key", "text_hash", F.explode(F.filter("near", lambda x, i: ~_next_to(x, i))).alias("lone")).select(
        "key", "text_hash", F.col("lone.spot").alias("spot"), F.col("lone.print").alias("hash"))


def _wanted(kept: DataFrame, twice: DataFrame, stored: DataFrame) -> DataFrame:
    """key, text_hash, spots: the places around which windows are looked at, of the kept hashes (key, text_hash, nth of the
    text, spot, print) that are in `twice`; a stored table.

    Two sieves let one hash in some hundred pass by chance. One that passes next to another of its text is taken as it is:
    both would have to pass by chance, and then a few windows are looked at in vain. Only those that pass alone are joined
    to `twice`, so the passages that very many documents share are no rows of a join.
    """
    texts = landed(_passed(kept, twice), stored)
    alone = _lone(texts).join(twice, "hash").groupBy("key", "text_hash").agg(F.collect_list("spot").alias("spots"))
    several = texts.select("key", "text_hash", F.filter("near", _next_to)["spot"].alias("spots")).where("size(spots) > 0")
    found = landed(several.union(alone).groupBy("key", "text_hash").agg(F.flatten(F.collect_list("spots")).alias("spots")), stored)
    dropped(texts)
    return found


def repeated(rows: DataFrame, given: DataFrame, length: int, stored: DataFrame) -> DataFrame:
    """The stretches of words that occur before, by key, text and place: key, text_hash, doc, others (keys of the documents
    that have them first), begin (word, from 0), words, taken (lines of which no word is left); a stored table.

    `rows` has a row for each input row: key, text_hash, doc, n (words), d1, d2 (hashes of all words), lines, starts (lines
    with a word, and their first), spots, prints (see `winnowed`); taken from the landed table `stored`. `given`: key,
    text_hash, text. In one document a run is no repeat of one that it overlaps.
    """
    rows, own = rows.where(F.col("n") >= length), F.struct("key", "text_hash")
    named = F.struct("key", "text_hash", "doc")
    several = landed(rows.groupBy("d1", "d2").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), stored)
    copies = landed(rows.select("key", "text_hash", "doc", "d1", "d2").join(several, ["d1", "d2"]).where(named != F.col("first")).select(
        "key", "text_hash", "doc", "first"), stored)
    single = without(rows.select("doc", "key", "text_hash", "spots", "prints"), copies.select("doc"), "doc")
    kept = single.select("key", "text_hash", F.posexplode(F.arrays_zip("spots", "prints")).alias("nth", "kept")).select(
        "key", "text_hash", "nth", F.col("kept.spots").alias("spot"), short(F.col("kept.prints")).alias("print"))
    twice = repeated_hashes(kept, "print", stored)
    wanted = _wanted(kept, twice, stored)
    let = told(given, wanted, "key", "text_hash").where("_may")
    texts = let.join(wanted, let["key"].eqNullSafe(wanted["key"]) & (let["text_hash"] == wanted["text_hash"])).select(
        let["key"], let["text_hash"], "text", "spots")
    found_windows = landed(_windows(texts, length))
    again = repeated_hashes(found_windows, "f", found_windows)
    windows = sifted(found_windows, short(F.col("f")), sieve(again, "hash")).where("_may").drop("_may")
    place = F.struct("key", "text_hash", "pos")
    firsts = landed(windows.groupBy("f").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = own == F.struct(F.col("first.key").alias("key"), F.col("first.text_hash").alias("text_hash"))
    later = windows.join(firsts, "f").where(~(same & (F.col("pos") - F.col("first.pos") < length)))
    cover = later.groupBy("key", "text_hash").agg(F.collect_set("pos").alias("at"), F.collect_set("first.key").alias("others"))
    whole = copies.where(~same).select(
        "key", "text_hash", F.lit(None).cast("array<int>").alias("at"), F.array_compact(F.array("first.key")).alias("others")).distinct()
    cover = landed(cover.union(whole))
    ours = told(rows.select("key", "text_hash", "doc", "n", "lines", "starts"), cover, "key", "text_hash").where("_may")
    joined = ours.join(cover, ours["key"].eqNullSafe(cover["key"]) & (ours["text_hash"] == cover["text_hash"])).select(
        ours["key"], ours["text_hash"], "doc", "n", "lines", "starts", "at", "others")
    found = landed(_spans(joined, length))
    dropped(several, copies, twice, wanted, found_windows, again, firsts, cover)
    return found


def cut(text: str | None, gone: list[int] | None, spans: list | None) -> str | None:
    """The text without the lines `gone` and the words of `spans` (begin, end); a line that loses all its words goes."""
    if text is None:
        return None
    lost = bytearray(max((e for _, e in spans), default=0))
    for b, e in spans:
        lost[b:e] = b"\1" * (e - b)
    out, end, gone = [], 0, set(gone or ())
    for number, line in enumerate(text.split("\n")):
        words = [x.span() for x in _WORD.finditer(line)]
        begin, end = end, end + len(words)
        mine = lost[begin:end]
        if number in gone or words and mine.count(1) == len(words):
            continue
        if not any(mine):
            out.append(line)
            continue
        mine, at, k = mine.ljust(len(words), b"\0"), 0, 0
        parts = []
        while k < len(words):
            if not mine[k]:
                k += 1
                continue
            after = k
            while after < len(words) and mine[after]:
                after += 1
            if after < len(words):
                parts.append(line[at: words[k][0]])
                at = words[after][0]
            else:
                parts.append(line[at: words[k - 1][1]])
                at = words[-1][1]
            k = after
        out.append("".join(parts) + line[at:])
    return "\n".join(out)
