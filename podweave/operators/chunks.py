"""Ordered streams cut into chunks.

Batching, admission and the as-of join go through a stream in order, and one stream may hold a third of all rows. So a
stream is cut into chunks of consecutive rows, each chunk is sorted and worked on by itself, and what a chunk needs to
know about the rows before it arrives as one *seed row* in front of its first row. Seeds come from one summary row per
chunk. Payloads are shuffled by (stream, chunk), never by the stream alone.

A chunk column must not decrease along the order column. Lines read from files have one by nature: the file split
(``sources.logdir``). For a sequence number, ``add_chunk`` makes one.
"""

import re
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podweave.functions.bytes import floor_div
from podweave.settings import BROADCAST_BYTES, CHUNK_ROWS, CHUNK_SPAN, MOST_CHUNKS


def add_chunk(df: DataFrame, order: str, span: int = CHUNK_SPAN, name: str = "chunk") -> DataFrame:
    """Chunks of ``span`` consecutive order values: with an order unique in its stream, at most that many rows each."""
    return df.withColumn(name, floor_div(F.col(order).cast("bigint"), span))


def in_chunks(df: DataFrame, keys: list[str], chunk: str, *order: Column | str) -> DataFrame:
    """Every (keys, chunk) group whole in one partition and in order, in ``spark.sql.shuffle.partitions`` partitions.

    The number is given so that AQE does not merge partitions by their few bytes: the folds behind cost time per row.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys, chunk).sortWithinPartitions(*keys, chunk, *order)


def runs(frames: Iterable[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """The runs of equal ``by`` values, as (key, column arrays); a group longer than an Arrow batch comes as several
    runs of the same key."""
    for frame in frames:
        if frame.empty:
            continue
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        new = np.zeros(len(frame), dtype=bool)
        for c in by:
            new[1:] |= columns[c][1:] != columns[c][:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for start, end in zip(starts, [*starts[1:], len(frame)]):
            yield tuple(columns[c][start] for c in by), {c: a[start:end] for c, a in columns.items()}


def in_frames(rows: Iterator[tuple], columns: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    """Rows packed into frames: groups are many and small."""
    while some := list(islice(rows, size)):
        yield pd.DataFrame(some, columns=columns)


def long_streams(df: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """The keys that have more than one chunk."""
    spans = df.groupBy(*keys).agg(F.min(chunk).alias("_low"), F.max(chunk).alias("_high"))
    return settle(spans.where("_low < _high").select(*keys))


def sparse_streams(df: DataFrame, keys: list[str], chunk: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """The keys with several chunks and at most ``rows`` rows, and their first chunk as ``_low``."""
    spans = df.groupBy(*keys).agg(F.min(chunk).alias("_low"), F.max(chunk).alias("_high"), F.count("*").alias("_rows"))
    return settle(spans.where((F.col("_low") < F.col("_high")) & (F.col("_rows") <= rows)).select(*keys, "_low"))


def few_chunks(df: DataFrame, keys: list[str], chunk: str, sparse: DataFrame) -> DataFrame:
    """The same rows, those of the sparse streams all in their first chunk.

    A sequence number over all streams puts a sparse stream into every chunk; the folds would then work on a few rows at
    a time, with a seed for each. For slim rows: with very many such keys the join is a shuffle.
    """
    merged = join_lookup(df, sparse, keys, "left")
    return merged.withColumn(chunk, F.coalesce("_low", chunk)).select(*df.columns)


def wide_chunks(df: DataFrame, keys: list[str], chunk: str, most: int = MOST_CHUNKS) -> DataFrame | None:
    """``keys, chunk, _low`` for the streams of more than ``most`` chunks: neighbours joined to about ``most`` chunks of as
    many rows, named by their first. None without such a stream.

    What is kept for each chunk of a stream passes one task in order, so its number must not grow with the stream.
    """
    sizes = df.groupBy(*keys, chunk).agg(F.count("*").alias("_rows"))
    long = settle(sizes.groupBy(*keys).agg(F.count("*").alias("_chunks"), F.sum("_rows").alias("_all")).where(F.col("_chunks") > most))
    if long.isEmpty():
        return None
    earlier = F.coalesce(F.sum("_rows").over(before(keys, chunk)), F.lit(0))
    placed = join_lookup(sizes, long, keys).withColumn("_group", F.floor(earlier * most / F.col("_all")))
    low = F.min(chunk).over(Window.partitionBy(*keys, "_group"))
    return settle(placed.select(*keys, chunk, low.alias("_low")))


def before(keys: list[str], chunk: str) -> Window:
    """All earlier chunks of the same stream, over chunk summaries."""
    return Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Without that setting a local session gets a temporary one; on a cluster,
    where tasks on other machines would not see it, that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to storage that the driver and all executors share")
    return _temporary.setdefault(context.applicationId, tempfile.mkdtemp(prefix="podweave-"))


_temporary: dict[str, str] = {}


def join_lookup(df: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", limit=BROADCAST_BYTES) -> DataFrame:
    """Join a lookup table: broadcast when its rows are measured to be small, else a shuffle join that AQE splits at hot
    keys. The measure is the length of the rows as JSON, summed up on the executors."""
    size = lookup.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return df.join(F.broadcast(lookup) if size <= limit else lookup, on, how)


def number_rows(df: DataFrame, *order: str, name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers by the order columns over the whole table, with no task seeing all of it.

    The ranges are settled first: a repeated range partitioning may draw its bounds elsewhere.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = settle(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    # One row per partition.
    firsts = ranged.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    numbered = ranged.join(F.broadcast(firsts.drop("_rows")), "_part")
    number = F.col("_at") - F.col("_first") + F.col("_base") + start
    return numbered.withColumn(name, number.cast("bigint")).drop("_part", "_at", "_first", "_base")
