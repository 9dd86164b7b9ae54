"""Similarity components of sets: families by shared keys, then tiles in which bitmaps bound and arrays decide.

Sets that share a key belong to one family; only members of a family can be linked. Families are found by star links
through the keys (never by pairs), and a set's array is shipped once, to its family. There, sets are compared in order
of size, each with those whose size lets them reach the similarity; the bit counts of hashed parity bitmaps bound the
overlap from above, and what passes is decided by intersecting the sorted arrays. Sets that are already connected are
not compared again, so a family of near copies costs little more than one comparison each.

A family beyond one block is cut into blocks. The first round compares inside each block, and with the family's first
set; the second compares what is then not connected to that first set with everything else, block by block. No task
holds more than two blocks, and no pair of sets that could add to the components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podweave.llm.components import components
from podweave.llm.landing import dropped, in_arrow, landed
from podweave.llm.sieve import repeated_hashes, short, sieve, sifted
from podweave.llm.textarrays import grouped

#: A block holds about so many sets, and array entries, at most.
BLOCK_SETS, BLOCK_ENTRIES = 512, 400_000

_BITS = 1024


def families(postings: DataFrame, stored: DataFrame) -> DataFrame:
    """id, family of the ids that share a key with another one (`postings`: key, id; each id once at each key), taken from
    the landed table `stored`."""
    # most keys are of one set only: nothing but their short forms is shuffled, and the rest of them goes no further
    twice = repeated_hashes(postings, "key", stored)
    near = landed(sifted(postings, short(F.col("key")), sieve(twice, "hash")).where("_may").select("key", "id"), stored)
    shared = landed(near.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").select("key", "first"), stored)
    stars = landed(near.join(shared, "key").where("id <> first").select(
        F.col("first").alias("a"), F.col("id").alias("b")).distinct(), stored)
    dropped(twice, near, shared)
    found = landed(components(stars).withColumnRenamed("component", "family"), stars)
    dropped(stars)
    return found


def _bitmap(values: np.ndarray) -> np.ndarray:
    """Parity of the number of entries that hash to each bit."""
    bits = np.bincount(values & np.uint64(_BITS - 1), minlength=_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def tile_links(ids: np.ndarray, sides: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (from each set to the smallest id of its component in the tile) that connect all sets of the tile which are
    similar and not yet in one component; sets that had one label are taken as connected.

    Similar: 100 * intersection >= percent * union. If the tile has two sides, only sets of different sides are compared.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    ids, sides, labels, sets = ids[order], sides[order], labels[order].copy(), [sets[k] for k in order]
    sizes = np.array([len(x) for x in sets], np.int64)
    maps = np.stack([_bitmap(x) for x in sets])
    two = bool((sides != sides[0]).any())
    met = labels.copy()
    for k in range(len(sets) - 1):
        end = int(np.searchsorted(sizes, sizes[k] * 100 // percent, "right"))
        open_ = labels[k + 1: end] != labels[k]
        if two:
            open_ &= sides[k + 1: end] != sides[k]
        near = np.flatnonzero(open_) + k + 1
        if not len(near):
            continue
        differ = np.bitwise_count(maps[near] ^ maps[k]).sum(axis=1, dtype=np.int64)
        most = (sizes[near] + sizes[k] - differ) // 2  # no overlap can be larger: each bit that differs is a word on one side
        fits = 100 * most >= percent * (sizes[near] + sizes[k] - most)
        near, differ = near[fits], differ[fits]
        for other in near[np.argsort(differ, kind="stable")].tolist():
            if labels[other] == labels[k]:
                continue
            common = overlap(sets[k], sets[other])
            if 100 * common >= percent * (sizes[k] + sizes[other] - common):
                labels[labels == labels[other]] = labels[k]
    if (labels == met).all():
        return []
    # of the sets that came with one label, one is enough to tell that it is connected to others now
    _, one = np.unique(met, return_index=True)
    _, place = np.unique(labels[one], return_inverse=True)
    first = np.full(place.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, place, ids[one])
    return [(int(a), int(b)) for a, b in zip(first[place], ids[one], strict=True) if a != b]


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links a, b found in the tiles (columns family, i, j, side, label, id, set)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in grouped(batches, ["family", "i", "j"]):
            ids, one = np.unique(tile.column("id").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            held = tile.column("set").take(pa.array(one)).to_pylist()
            links = tile_links(ids, tile.column("side").to_numpy()[one], tile.column("label").to_numpy()[one],
                               [np.frombuffer(x, np.uint64) for x in held], percent)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    tiles = rows.select("family", "i", "j", "side", "label", "id", "set").repartition("family", "i", "j")
    return in_arrow(tiles.sortWithinPartitions("family", "i", "j"), compared, "a long, b long")


def similar_components(members: DataFrame, percent: int) -> DataFrame:
    """id, component of the sets that are linked, directly or not. `members`: id, family, n (entries), set (binary: sorted
    unsigned 64-bit numbers without repeats); a stored table, the family being the smallest id in it."""
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("entries"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("entries") / BLOCK_ENTRIES)).cast("int")
    sizes = landed(sizes.where("sets > 1").select("family", blocks.alias("blocks")), members)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cut = members.join(sizes, "family")
    # the family's first set meets every block
    spread = cut.withColumn("i", F.explode(F.when(
        F.col("id") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    links = landed(_compare(spread.withColumn("j", F.col("i")).withColumn("side", F.lit(0)).withColumn("label", F.col("id")), percent), members)
    large = landed(members.join(sizes.where("blocks > 1"), "family").select("id", "family", "n", "set"), members)
    stars = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    if large.isEmpty():  # every set was in one tile, which linked each to the first of its component
        return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
    label = landed(components(links), links)
    rows = large.join(label, "id", "left").withColumn("label", F.coalesce("component", "id"))
    rows = landed(rows.withColumn("rest", (F.col("label") != F.col("family")).cast("int")).drop("component"), members)
    counted = rows.groupBy("family", "rest").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("entries")).withColumn("b", blocks)
    parts = landed(counted.groupBy("family").agg(
        F.coalesce(F.max(F.when(F.col("rest") == 1, F.col("b"))), F.lit(0)).alias("rests"),
        F.coalesce(F.max(F.when(F.col("rest") == 0, F.col("b"))), F.lit(0)).alias("cores")).where("rests > 0"), members)
    met = rows.join(parts, "family")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("rest") == 1, F.col("rests")).otherwise(F.col("cores"))).cast("int")
    # blocks of the rest are numbered from 0, those of the core from `rests` on; the tiles are rest with rest and rest with core
    met = met.withColumn("own", F.when(F.col("rest") == 1, own).otherwise(own + F.col("rests"))).withColumn(
        "other", F.explode(F.when(F.col("rest") == 1, F.sequence(F.lit(0), F.col("rests") + F.col("cores") - 1)).otherwise(
            F.sequence(F.lit(0), F.col("rests") - 1))))
    tiles = met.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"), "label", "id", "set")
    more = landed(_compare(tiles, percent))
    # a tile tells of one set for each label it knew, so the links of the first round belong to the second's
    found = landed(components(label.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more)), members)
    dropped(sizes, large, links, label, rows, more, parts)
    return found
