"""What tells which rows cannot have a partner, before anything wide is shuffled: hashes that occur more than once, counted
as packed numbers, and a bitmap of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podweave.llm.landing import in_arrow, landed
from podweave.llm.textarrays import grouped

#: Slots of the bitmap: so many for each hash, in a power of two, between 128 kB and 32 MB of bits altogether. Beyond some
#: hundred million hashes the bitmap is full and holds less and less back; the results stay the same.
EACH, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 20, 1 << 28

#: Hashes are counted by so many of their bits: the upper ones name a bucket, the lower 32 are shuffled in its packs.
SHORT_BITS = 42

#: A task packs so many hashes at a time.
PACKED = 1 << 19


def short(hashed: Column) -> Column:
    """The part of 64-bit hashes that `repeated_hashes` counts."""
    return hashed.bitwiseAND(F.lit((1 << SHORT_BITS) - 1))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, packed (the lower halves of hashes): each hash once, or twice if it occurs again in what is held."""
    held: list[np.ndarray] = []

    def pack() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        values = np.repeat(values, np.minimum(n, 2))
        buckets, begins = np.unique(values >> 32, return_index=True)
        ends = np.append(begins, len(values)).astype(np.int32) * 4
        low = pa.py_buffer((values & 0xFFFFFFFF).astype(np.uint32).tobytes())
        packed = pa.Array.from_buffers(pa.binary(), len(buckets), [None, pa.py_buffer(ends.tobytes()), low])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), packed], ["bucket", "packed"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).to_numpy())
        if sum(map(len, held)) >= PACKED:
            yield pack()
    if held:
        yield pack()


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in grouped(batches, ["bucket"]):
        values = np.sort(np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint32))
        twice = np.unique(values[1:][values[1:] == values[:-1]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(twice + (table.column("bucket")[0].as_py() << 32))], ["hash"])


def repeated_hashes(rows: DataFrame, hashed: str, stored: DataFrame) -> DataFrame:
    """hash: the short form of the 64-bit hashes (no nulls) that more than one row has in the column `hashed`; a stored table.

    Two hashes of one short form count as one that occurs twice, so a few are there that occur once: this holds rows back,
    and what passes is compared in full. A hash takes 4 bytes of the shuffle, a third of a row with a count, and a very
    frequent one no more than twice for each pack.
    """
    packs = in_arrow(rows.select(short(F.col(hashed)).alias("hash")), _packs, "bucket long, packed binary")
    return landed(in_arrow(packs.repartition("bucket").sortWithinPartitions("bucket"), _repeats, "hash long"), stored)


@dataclass(frozen=True)
class Sieve:
    """A stored table of _bucket and _bits (at most MOST_SLOTS bits), and the number of slots."""

    bits: DataFrame
    slots: int


def _slot(hashed: Column, slots: int) -> Column:
    return F.pmod(hashed, F.lit(slots)) + 1


def sieve(hashes: DataFrame, hashed: str) -> Sieve:
    """The sieve of the 64-bit hashes in the column `hashed`."""
    wanted = 1 << max(0, EACH * hashes.count() - 1).bit_length()
    slots = max(min(wanted, MOST_SLOTS), min(LEAST_SLOTS, MOST_SLOTS))
    rows = hashes.select(_slot(F.col(hashed), slots).alias("slot"))
    return Sieve(landed(rows.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))), slots)


def sifted(rows: DataFrame, hashed: Column, bitmap: Sieve) -> DataFrame:
    """The rows with a column _may: false if `hashed` is surely none of the sieve's hashes. Nothing is shuffled."""
    slot = _slot(hashed, bitmap.slots)
    place = F.bitmap_bit_position(slot)
    byte = F.substring(F.col("_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(place, F.lit(8)).cast("int"))
    # the bitmap is broadcast: its size is bounded
    joined = rows.join(F.broadcast(bitmap.bits), F.bitmap_bucket_number(slot) == F.col("_bucket"), "left")
    return joined.withColumn("_may", F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_bits")


def told(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows with a column _may: false if surely no row of `wanted` (a stored table) has the same keys, nulls being equal."""
    hashed = F.xxhash64(*keys)
    return sifted(rows, hashed, sieve(wanted.select(hashed.alias("hashed")), "hashed"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` is not among `gone` (a stored table of that column): an anti-join that shuffles only the rows
    which the sieve cannot clear. A null key stays."""
    every = told(rows, gone, key)
    return every.where(~F.col("_may")).drop("_may").union(every.where("_may").drop("_may").join(gone, key, "left_anti").select(rows.columns))


def within(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows joined to `wanted` (a stored table) by the keys: only the rows that the sieve lets through are shuffled."""
    return told(rows, wanted, *keys).where("_may").drop("_may").join(wanted, list(keys))


def beside(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """All rows, with the other columns of `wanted` (a stored table) where the keys agree, else nulls: a left join that
    shuffles only the rows which the sieve cannot clear."""
    every = told(rows, wanted, *keys)
    none = [F.lit(None).cast(x.dataType).alias(x.name) for x in wanted.schema.fields if x.name not in keys]
    clear = every.where(~F.col("_may")).select(*rows.columns, *none)
    return clear.unionByName(every.where("_may").drop("_may").join(wanted, list(keys), "left"))
