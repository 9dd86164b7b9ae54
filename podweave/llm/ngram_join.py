"""N-gram Jaccard join: documents whose sets of word shingles overlap, exactly.

A set that is similar to another has nearly all of its entries in common with it. So the entries in a fixed part of the
hash space are counted first, over all sets: a set with more entries there that no other set has than it may lack in all
is similar to none, and most texts go no further. The others are put into families.

Two sets that reach the similarity have sizes within one band or its neighbour, and differ in at most k entries, k being
known from the band. The space of hashes is cut into more than k cells, so the two agree on all entries of some cell: a
hash of a cell's entries is a key, and sets without a common key cannot be linked. An empty cell is no key, so there are
spare cells; the few sets that leave more than these empty are also tied by their rarest entries. A passage that many
documents share seldom fills a cell alone, but among very many documents it does, so large families are divided by their
rarest entries. What is left goes through `tiles`: bitmap bounds, then exact intersection.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podweave.llm.landing import dropped, in_arrow, landed
from podweave.llm.sieve import repeated_hashes, short, sieve, sifted, told, within, without
from podweave.llm.textarrays import mixed, packed, pieces, shingle_hashes, word_hashes
from podweave.llm.tiles import families, similar_components

#: Ratio of the upper to the lower end of a size band; over 100 / percent, so that similar sets lie in neighbouring bands.
WIDTH = 1.235

#: Families of more sets than this are divided by their rarest entries.
LARGE = 64

#: The part of the hash space that is counted is so many times the part of its entries that a set may lack.
PART = 1.5


@functools.cache
def _bands(percent: int, most: int) -> tuple[list[int], list[int], list[int]]:
    """Lower ends of the bands up to size `most`, and the cells and spare cells of each."""
    width = max(WIDTH, 101 / percent)
    lows, cells, spares = [1], [], []
    while lows[-1] <= most or len(lows) < 3:
        low, high = lows[-1], max(lows[-1] + 1, int(np.ceil(lows[-1] * width)))
        small = high - 1
        # intersection >= percent / (100 + percent) of both sizes together, so the difference is at most the rest
        differ = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
        spare = 0
        if differ:  # as many spare cells as the band's smallest sets leave empty, but for a few of them
            while spare < (differ + 1) // 2 + 1:
                empty = (differ + 1 + spare) * (1 - 1 / (differ + 1 + spare)) ** low
                if spare >= empty + 3 * np.sqrt(empty):
                    break
                spare += 1
        cells.append(differ + 1 + spare)
        spares.append(spare)
        lows.append(high)
    return lows, cells, spares


def cell_keys(values: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """Keys of one sorted set of hashes, one for each cell that has entries, and the bands in which the set is loose.

    Two sets that reach the similarity agree in more cells of a common band than it has spare cells. Unless both leave
    more than these empty, which is to be loose, one of the cells in which they agree has entries, and is a key of both.
    """
    size = len(values)
    if not size:
        return np.zeros(0, np.uint64), []
    most = 1 << max(10, size.bit_length())
    lows, cells, spares = _bands(percent, most)
    band = bisect.bisect_right(lows, size) - 1
    found, loose = [], []
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values), dtype=np.uint64)))
    for scheme in (band, band - 1):
        if scheme < 0 or scheme < band and size > (lows[band] - 1) * 100 // percent:
            continue
        count = cells[scheme]
        cell = ((values >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        ends = np.searchsorted(cell, np.arange(count + 1, dtype=np.uint64))
        content = sums[ends[1:]] - sums[ends[:-1]]
        keys = mixed(content ^ mixed(np.arange(count, dtype=np.uint64) + np.uint64(scheme << 32)))
        full = ends[1:] > ends[:-1]
        found.append(keys[full])
        if count - np.count_nonzero(full) > spares[scheme]:
            loose.append(scheme)
    return np.concatenate(found), loose


def _distinct(texts: list[str], width: int) -> Iterator[np.ndarray]:
    hashes, first, _ = word_hashes(texts)
    for values in shingle_hashes(hashes, first, width):
        yield np.unique(values)


def counted_part(values: np.ndarray, percent: int) -> np.ndarray:
    """The entries of a sorted set that lie in the part of the hash space which is counted."""
    end = min(PART * (100 - percent) / 100, 1.0) * 2.0**64
    return values[: np.searchsorted(values, np.uint64(min(int(end), (1 << 64) - 1)))]


def _loose(values: np.ndarray, bands: list[int]) -> list[np.ndarray]:
    """For each of at most two bands, all entries of the set as keys of that band."""
    found = [mixed(values ^ mixed(np.array([(1 << 40) + b], np.uint64))) for b in bands]
    return found + [np.zeros(0, np.uint64)] * (2 - len(found))


def _lacking(n: Column, percent: int) -> Column:
    """How many of its n entries a set may have that a similar one lacks."""
    return F.floor(n * (100 - percent) / 100)


def _features(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """key, text_hash, n, f1, f2 (fingerprints of the set), part (its counted part)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in pieces(batch.column("text").to_pylist()):
                sets, part = list(_distinct(texts, width)), batch.slice(begun, len(texts))
                prints = [[len(x), *(mixed(x + np.uint64(s)).sum(dtype=np.uint64).astype(np.int64) for s in (1, 2))] for x in sets]
                n, f1, f2 = (pa.array(x, pa.int64()) for x in np.array(prints, np.int64).reshape(-1, 3).T.copy())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("text_hash"), n, f1, f2, packed([counted_part(x, percent) for x in sets])],
                    ["key", "text_hash", "n", "f1", "f2", "part"])

    kind = documents.schema["key"].dataType.simpleString()
    return in_arrow(documents, features, f"key {kind}, text_hash long, n long, f1 long, f2 long, part array<long>")


def _promising(sets: DataFrame, percent: int, stored: DataFrame) -> DataFrame:
    """id of the sets (id, n, part; no two equal) that may be similar to another one."""
    entries = sets.select("id", F.explode("part").alias("entry"))
    twice = repeated_hashes(entries, "entry", stored)
    met = sifted(entries, short(F.col("entry")), sieve(twice, "hash")).where("_may").groupBy("id").agg(F.count(F.lit(1)).alias("met"))
    counted = sets.select("id", "n", F.size("part").alias("counted"))  # the parts themselves are not shuffled
    alone = F.col("counted") - F.coalesce("met", F.lit(0))
    found = landed(counted.join(landed(met, stored), "id", "left").where(alone <= _lacking(F.col("n"), percent)).select("id"), stored)
    dropped(twice)
    return found


def _sets(rows: DataFrame, width: int, percent: int, held: bool = True) -> DataFrame:
    """id, n, set, keys, loose_a, loose_b of rows id, text; set is null unless sets are to be held."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in pieces(batch.column("text").to_pylist()):
                found, part = list(_distinct(texts, width)), batch.slice(begun, len(texts))
                keys = [cell_keys(x, percent) for x in found]
                loose = [_loose(x, bands) for x, (_, bands) in zip(found, keys, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() if held else None for x in found], pa.binary()),
                     *(packed(column) for column in ([k for k, _ in keys], [a for a, _ in loose], [b for _, b in loose]))],
                    ["id", "n", "set", "keys", "loose_a", "loose_b"])

    lists = ", ".join(f"{c} array<long>" for c in ("keys", "loose_a", "loose_b"))
    return in_arrow(rows, sets, f"id long, n long, set binary, {lists}")


def _texts(given: DataFrame, wanted: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows id, text of `given` that the sieve of `wanted` (a stored table with id) lets through, each id that is in
    `repeated` (a stored table of ids) once. Of all texts none is shuffled but those of repeated rows."""
    near = told(given.select("id", "text"), wanted, "id").where("_may").drop("_may")
    if repeated.isEmpty():
        return near
    every = told(near, repeated, "id")
    once = every.where("_may").groupBy("id").agg(F.first("text").alias("text"))
    return every.where(~F.col("_may")).drop("_may").unionByName(once)


def _short_sets(rows: DataFrame, width: int) -> DataFrame:
    """id, n, set of rows id, text: the set's 8 * n bytes, or the text of which it is made, if that is less once it is compressed
    (hashes cannot be); a text of 8 * n bytes is not taken, so the length tells which it is."""

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in pieces(batch.column("text").to_pylist()):
                held, plain = list(_distinct(texts, width)), [x.encode() for x in texts]
                shorter = [t if 8 * len(x) != len(t) < 12 * len(x) else x.tobytes() for x, t in zip(held, plain, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begun, len(texts)), pa.array([len(x) for x in held], pa.int64()), pa.array(shorter, pa.binary())],
                    ["id", "n", "set"])

    return in_arrow(rows, shortened, "id long, n long, set binary")


def _whole_sets(rows: DataFrame, width: int) -> DataFrame:
    """id, family, n, set of rows id, family, n, set (see `_short_sets`)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short_sets = batch.column("set").to_pylist()
            plain = ["" if len(x) == 8 * n else x.decode() for x, n in zip(short_sets, batch.column("n").to_pylist(), strict=True)]
            for begun, texts in pieces(plain):
                part = batch.slice(begun, len(texts))
                sets = [x.tobytes() if text else short_sets[begun + k] for k, (text, x) in enumerate(zip(texts, _distinct(texts, width), strict=True))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "family", "n")), pa.array(sets, pa.binary())], ["id", "family", "n", "set"])

    return in_arrow(rows.select("id", "family", "n", "set"), whole, "id long, family long, n long, set binary")


def _rarest(entries: DataFrame, percent: int, stored: DataFrame | None = None) -> DataFrame:
    """key, id: the rarest entries of each set, so many that a similar set has one of them. `entries`: id, part, n, key, all
    entries of each set in that part.

    Entries of one set only are the rarest and tie nothing; they are counted and left out, most of them before any shuffle
    if a landed table is given, `stored`, from which the entries are taken."""
    if stored is not None:
        twice = repeated_hashes(entries, "key", stored)
        entries = sifted(entries, short(F.col("key")), sieve(twice, "hash")).where("_may").drop("_may")
    counts = landed(entries.groupBy("key").agg(F.count(F.lit(1)).alias("common")).where("common > 1"))
    own = Window.partitionBy("id", "part")
    place = F.row_number().over(own.orderBy("common", "key")) + F.col("n") - F.count(F.lit(1)).over(own)
    known = entries.join(counts, "key").withColumn("place", place)
    return known.where(F.col("place") <= _lacking(F.col("n"), percent) + 1).select("key", "id")


def _loose_keys(sets: DataFrame, percent: int) -> DataFrame:
    """key, id of the loose sets (`sets`: id, n, loose_a, loose_b), which are few."""
    rows = sets.where("size(loose_a) > 0").select("id", "n", F.posexplode(F.array("loose_a", "loose_b")).alias("part", "entries"))
    return _rarest(rows.select("id", "part", "n", F.explode("entries").alias("key")), percent)


def _renamed(found: DataFrame, names: DataFrame) -> DataFrame:
    """id (`own` of the same id in `names`), family (the smallest such id in it) of `found` (id, family); a stored table."""
    named = landed(within(names.select("id", "own"), found, "id").select("own", "family"))
    firsts = landed(named.groupBy("family").agg(F.min("own").alias("first")), named)
    renamed = landed(named.join(firsts, "family").select(F.col("own").alias("id"), F.col("first").alias("family")))
    dropped(found, named, firsts)
    return renamed


def _divided(found: DataFrame, sets: DataFrame, percent: int, width: int = 0) -> DataFrame:
    """id, family of the sets in `found` (id, family), large families divided by their rarest entries; a stored table.
    `sets`: id, n, set (see `_short_sets`; without texts no width is needed)."""
    large = landed(found.groupBy("family").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > LARGE).select("family"), found)
    if large.isEmpty():
        return found

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a set at a time: it may be as large as a text
                values = np.frombuffer(batch.column("set")[k].as_py(), np.uint64)
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [row.column("id"), row.column("family"), row.column("n"), packed([values])], ["id", "family", "n", "entries"])

    wanted = landed(found.join(large, "family").select("id", "family"), found)
    rows = _whole_sets(within(sets.select("id", "n", "set"), wanted, "id"), width)
    rows = landed(in_arrow(rows, spread, "id long, family long, n long, entries array<long>"))
    # a family's number makes its entries its own
    entries = rows.select("id", F.lit(0).alias("part"), "n", F.explode("entries").alias("key"), "family").withColumn(
        "key", F.xxhash64("family", "key")).drop("family")
    again = families(landed(_rarest(entries, percent, rows)), rows)
    divided = landed(found.join(large, "family", "left_anti").select("id", "family").union(again.select("id", "family")))
    dropped(found, large, wanted, rows, again)
    return divided


def _joined(documents: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """key, text_hash, n, component (any number it has; null without a set), component_id, n_copies of every row."""
    given = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    # a row's id tells its text wherever it is read again; repeated rows have one
    identity = F.xxhash64("key", "text_hash").alias("id")
    rows = landed(_features(given, width, percent).withColumn("row", F.monotonically_increasing_id()))
    prints = ["n", "f1", "f2"]
    classes = landed(rows.where("n > 0").select("*", identity).groupBy(*prints).agg(
        F.min("row").alias("row"), F.min_by("id", "row").alias("first"), F.min("key").alias("least"), F.count(F.lit(1)).alias("n_copies")), rows)
    several = landed(classes.where("n_copies > 1").select(*prints, F.col("row").alias("kept")), rows)
    copies = landed(within(rows.where("n > 0").select("row", *prints), several, *prints).where("row <> kept").select("row"), rows)
    single = without(rows.where("n > 0").select("row", identity, "n", "part"), copies, "row")
    promising = _promising(single, percent, rows)
    repeated = landed(rows.groupBy(identity).count().where("count > 1").select("id"), rows)
    slim = landed(rows.select("key", "text_hash", *prints), rows)
    dropped(rows, several, copies)  # the counted parts are large
    # one row of each set stands for it; a few more that the sieve lets through are equal to it, or similar to none
    given = given.select(identity, "text")
    keyed = _sets(_texts(given, promising, repeated), width, percent, held=False).withColumnRenamed("id", "own")
    keyed = landed(keyed.withColumn("id", F.monotonically_increasing_id()))  # consecutive numbers take less of a shuffle
    loose = landed(_loose_keys(keyed, percent))
    found = families(keyed.select(F.explode(F.array_distinct("keys")).alias("key"), "id").union(loose), keyed)
    found = _renamed(found, keyed)
    dropped(promising, keyed, loose)
    sets = landed(_short_sets(_texts(given, found, repeated), width))
    found = _divided(found, sets, percent, width)
    members = landed(_whole_sets(within(sets, found, "id"), width))
    dropped(repeated, sets, found)
    linked = similar_components(members, percent)
    tied = classes.join(linked.withColumnRenamed("id", "first"), "first", "left").withColumn(
        "component", F.coalesce("component", "first"))
    names = landed(tied.groupBy("component").agg(F.min("least").alias("component_id")), slim)
    tied = landed(tied.join(names, "component").select(*prints, "component", "component_id", "n_copies"), slim)
    dropped(classes, members, linked, names)
    return slim.join(tied, prints, "left").select("key", "text_hash", "n", "component", "component_id", "n_copies")


def ngram_join(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, n_copies.

    A row's set: the distinct windows of `width` words `[^\\x20\\x09-\\x0D]+`, A-Z lowered; of fewer words the whole
    sequence; without words or text it is empty and linked with nothing. Rows link if 100 * intersection >= percent *
    union. component_id: the smallest key reachable by links, the row's own included; n_copies: rows with the same set.

    Equal sets are one set to the join, however many rows have them. A row with a null key takes part, but gives its
    component no name; a component without any key has none. Repeated rows are copies. Other columns are not looked at.
    Sets are compared by 64-bit hashes of their windows, and rows are told by one of key and text. Needs the shared folder.
    """
    return _joined(documents, key, text, width, percent).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """The documents, all columns, one of each component of `ngram_join`: the row of the smallest key, and of its rows in
    the component the one whose text has the smallest hash.

    A key may have rows in several components, and each of these keeps one. Rows without key or without words stay, and
    no row goes on account of a row without key. Of repeated rows one stays.
    """
    joined = landed(_joined(documents, key, text, width, percent).where("key IS NOT NULL AND component IS NOT NULL"))
    row = F.struct("key", "text_hash")
    firsts = landed(joined.groupBy("component").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = joined.join(firsts, "component")
    gone = landed(members.where(row != F.col("first")).select("key", "text_hash").distinct())
    several = landed(members.where(row == F.col("first")).groupBy("key", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    columns = [F.col(f"document.{c}") for c in documents.columns]
    rows = documents.select(F.struct(*documents.columns).alias("document"), F.col(key).alias("own"), F.xxhash64(text).alias("own_hash"))
    rows = sifted(rows, F.xxhash64("own", "own_hash"), sieve(gone.union(several).select(F.xxhash64("key", "text_hash").alias("hashed")), "hashed"))
    dropped(joined, firsts)
    same = (F.col("own") == F.col("key")) & (F.col("own_hash") == F.col("text_hash"))
    safe = rows.where(~F.col("_may")).select(*columns)  # neither to go nor to be told apart: nothing to join
    # most of the others go, so keys alone tell which ones stay, and only these are shuffled whole
    likely = rows.where("_may").drop("_may")
    stay = landed(likely.select("own", "own_hash").distinct().join(gone, same, "left_anti").select(
        F.col("own").alias("stays"), F.col("own_hash").alias("stays_hash")))
    hashes = stay.select(F.xxhash64("stays", "stays_hash").alias("hashed"))
    left = sifted(likely, F.xxhash64("own", "own_hash"), sieve(hashes, "hashed")).where("_may").drop("_may").join(
        stay, F.col("own").eqNullSafe(F.col("stays")) & (F.col("own_hash") == F.col("stays_hash")), "left_semi")
    if several.isEmpty():
        return safe.union(left.select(*columns))
    single = left.join(several, same, "left_anti")
    twice = left.join(several, same, "left_semi")
    # repeated rows may be very many: each task keeps one of its own first
    one = twice.groupBy("own", "own_hash").agg(F.first("document").alias("document"))
    return safe.union(single.select(*columns)).union(one.select(*columns))
