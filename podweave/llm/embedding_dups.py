"""Embedding near-duplicates: random-hyperplane signatures in several tables, exact cosine, connected components.

Equal vectors are one class before anything else. In each table a class falls into the bucket of its sign bits; classes
of one bucket are compared exactly, in tiles of bounded size. A pair that meets in several tables is counted in the first
one only: every class carries its signatures of all tables, so each tile knows. Tiles report counts and a star for each
group they connect, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podweave.llm.components import components
from podweave.llm.landing import dropped, in_arrow, landed
from podweave.llm.textarrays import grouped

#: Classes of a bucket that one side of a tile holds on average.
BLOCK = 1024


def tables_for(classes: int, least: float, missed: float, fill: int = 32) -> tuple[int, int]:
    """(bits, tables): buckets of about `fill` of unrelated vectors, and so many tables that of the pairs right at the
    cosine `least` no more than `missed` never share a bucket. Both grow with the logarithm of the number of classes, or
    a small power of it, not with the data."""
    same = 1 - math.acos(least) / math.pi
    bits = min(48, max(4, math.ceil(math.log2(max(classes, 1) / fill)))) if classes > fill else 4
    return bits, math.ceil(math.log(missed) / math.log(1 - same**bits))


def _planes(seed: int, size: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, count))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of float lists of equal length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _signed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """id, n, vector, size and signatures (one number for each table)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("size").to_numpy()
            out = np.zeros((batch.num_rows, tables), np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                matrix = _matrix(batch.column("vector").take(pa.array(rows)))
                signs = matrix @ _planes(seed, size, bits * tables) > 0
                out[rows] = signs.reshape(len(rows), tables, bits) @ weights
            offsets = np.arange(0, (batch.num_rows + 1) * tables, tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("id", "n", "size", "vector")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))],
                ["id", "n", "size", "vector", "signatures"])

    return in_arrow(classes.select("id", "n", "size", "vector"), 
        signed, f"id long, n long, size int, vector {classes.schema['vector'].dataType.simpleString()}, signatures array<long>")


def tile_links(vectors: np.ndarray, sides: np.ndarray, copies: np.ndarray, earlier: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows linked to each row and first met here, the smallest row of each row's component in this tile)."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    linked = (vectors @ vectors.T) / np.outer(norms, norms) >= least
    if (sides != sides[0]).any():
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, False)
    counts = np.zeros(len(vectors), np.int64)
    a, b = np.nonzero(linked)
    for k in range(0, len(a), 1 << 18):
        p, q = a[k: k + (1 << 18)], b[k: k + (1 << 18)]
        new = ~(earlier[p] == earlier[q]).any(axis=1) if earlier.shape[1] else np.ones(len(p), bool)
        counts += np.bincount(p[new], copies[q[new]], len(vectors)).astype(np.int64)
    label = np.arange(len(vectors))
    while len(a):
        least_near = label.copy()
        np.minimum.at(least_near, a, label[b])
        least_near = np.minimum(least_near, least_near[least_near])
        if (least_near == label).all():
            break
        label = least_near
    return counts, label


def _compare(tiles: DataFrame, least: float) -> DataFrame:
    """id, found (rows linked), tied (smallest id connected in the tile) from the tiles (t, size, code, i, j, side, ...)."""
    keys = ["t", "size", "code", "i", "j"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in grouped(batches, keys):
            if tile.num_rows < 2:
                continue
            tile = tile.sort_by("id").combine_chunks()
            ids = tile.column("id").to_numpy()
            table = int(tile.column("t")[0].as_py())
            signatures = np.stack(tile.column("signatures").to_pylist()).astype(np.int64)[:, :table]
            counts, label = tile_links(_matrix(tile.column("vector").chunk(0)), tile.column("side").to_numpy(), tile.column("n").to_numpy(),
                                       signatures, least)
            told = (counts > 0) | (label != np.arange(len(ids)))
            if told.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[told]), pa.array(counts[told]), pa.array(ids[label[told]])], ["id", "found", "tied"])

    rows = tiles.select(*keys, "side", "id", "n", "vector", "signatures").repartition(*keys).sortWithinPartitions(*keys)
    return in_arrow(rows, compared, "id long, found long, tied long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95,
                    missed: float = 0.001, seed: int = 7) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Rows link if the cosine of their vectors, in double precision, is `least` or more; every link that is reported has
    been computed, and of the pairs right at `least` about `missed` are never compared (of closer pairs far fewer; equal
    vectors always link). n_links: other rows linked directly. component_id: the smallest key reachable by links, the
    row's own included. kept: key = component_id.

    Vectors that are null or zero, or hold a null, NaN or infinity, link with nothing, nor do vectors of different
    length. Repeated rows are rows with equal vectors. A row without key counts as a link but names no component. Other
    columns are not looked at. Needs the shared folder.
    """
    good = F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    given = vectors.select(F.col(key).alias("key"), F.when(good, F.col(vector)).alias("vector"))
    rows = landed(given.withColumn("id", F.monotonically_increasing_id()).withColumn("print", F.xxhash64("vector")))
    same = ["print", "vector"]
    classes = landed(rows.where("vector IS NOT NULL").groupBy(*same).agg(
        F.min("id").alias("id"), F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("size", F.size("vector")), rows)
    bits, tables = tables_for(classes.count(), least, missed)
    signed = landed(_signed(classes, bits, tables, seed))
    codes = signed.select("id", "size", F.posexplode("signatures").alias("t", "code"))
    buckets = codes.groupBy("t", "size", "code").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = landed(buckets.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), signed)
    met = signed.select("id", "n", "size", "vector", "signatures", F.posexplode("signatures").alias("t", "code")).join(
        buckets, ["t", "size", "code"])
    own = F.pmod(F.xxhash64("id", "t"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn(
        "side", (F.col("own") > F.col("other")).cast("int"))
    found = landed(_compare(tiles, least))
    counts = found.groupBy("id").agg(F.sum("found").alias("found"))
    tied = components(found.select(F.col("id").alias("a"), F.col("tied").alias("b")))
    told = classes.join(counts, "id", "left").join(tied, "id", "left").withColumn("component", F.coalesce("component", "id"))
    told = landed(told.select(*same, "least", "n", "component", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("links")), rows)
    names = landed(told.groupBy("component").agg(F.min("least").alias("name")), rows)
    told = landed(told.join(names, "component").select(*same, "links", "name"), rows)
    dropped(classes, signed, buckets, found, names)
    joined = rows.join(told.withColumnRenamed("vector", "v").withColumnRenamed("print", "p"),
                       (F.col("print") == F.col("p")) & (F.col("vector") == F.col("v")), "left")
    component = F.when(F.col("p").isNotNull(), F.col("name")).otherwise(F.col("key"))
    return joined.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
