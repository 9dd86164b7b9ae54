"""Substring dedup: near copies of paragraphs, and repeated passages of any place (`passages`).

MinHash bands find candidates among paragraphs, exact Jaccard decides, components are cut to one.
A paragraph is a line of at least `min_words` words, or so many words of consecutive shorter lines, joined from starts that
the lines' own words choose, so that shifted copies agree. Equal paragraphs are one class before anything else. Each class has
`bands` keys of `rows` minima over its word shingles; classes that share a key are compared exactly in `tiles`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from podweave.llm.landing import dropped, in_arrow, landed
from podweave.llm.passages import cut, repeated, run_hashes, winnowed
from podweave.llm.sieve import beside, repeated_hashes, short, sieve, sifted, told, within, without
from podweave.llm.textarrays import codepoints, mixed, packed, pieces, shingle_hashes, word_hashes
from podweave.llm.tiles import families, similar_components


def recall(similarity: float, bands: int, rows: int) -> float:
    """Chance that two paragraphs of this similarity share a key."""
    return 1 - (1 - similarity**rows) ** bands


def tuned_bands(percent: int, rows: int, missed: float) -> int:
    """The fewest bands that leave at most `missed` of the pairs right at the similarity without a common key."""
    bands = 1
    while 1 - recall(percent / 100, bands, rows) > missed:
        bands += 1
    return bands


def _lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes; first word of each text, one more at the end; and of the lines with a word: text, line within the text,
    first word, words)."""
    points, at = codepoints(texts)
    hashes, own, starts = word_hashes(texts)
    feeds = np.flatnonzero(points == 10)
    line = np.searchsorted(feeds, starts)  # lines are counted through all texts
    first = np.searchsorted(feeds, at[:-1])  # the line with which each text begins
    lines, begins, sizes = np.unique(line, return_index=True, return_counts=True)
    owner = np.searchsorted(first, lines, "right") - 1
    return hashes, own, owner, lines - first[owner], begins, sizes


def _starts(run: np.ndarray, begins: np.ndarray, sizes: np.ndarray, marks: np.ndarray, min_words: int) -> np.ndarray:
    """Whether a paragraph starts at each of these short lines; `run` numbers the runs of consecutive ones.

    A line starts one if its mark is the least of all lines of the run that begin within `min_words` words of it on either
    side (of equal ones the first), which nothing further away can change; so starts are `min_words` words apart. What is
    shorter before the first start or after the last joins its neighbour.
    """
    starts, least = np.append(True, run[1:] != run[:-1])[: len(run)], np.ones(len(run), bool)
    for d in range(1, min_words):
        near = (run[d:] == run[:-d]) & (begins[d:] - begins[:-d] < min_words)
        if not near.any():
            break
        least[:-d] &= ~near | (marks[:-d] <= marks[d:])
        least[d:] &= ~near | (marks[d:] < marks[:-d])
    heads = np.flatnonzero(starts)
    starts = starts | least
    at = np.flatnonzero(starts)
    words = np.add.reduceat(sizes, at)
    head = np.isin(at, heads)
    last = np.append(head[1:], True)
    joins = ~head & (words < min_words) & last
    joins[1:] |= ~head[1:] & head[:-1] & (words[:-1] < min_words)
    starts[at[joins]] = False
    return starts


def _paragraphs(lines: tuple[np.ndarray, ...], min_words: int) -> tuple[np.ndarray, ...]:
    """(text, first line within the text, last line, first word within the text, word hashes one after the other, first of
    each; one more at the end) of the paragraphs among `_lines`: lines of `min_words` words, and consecutive shorter lines
    joined to as many; lines without a word don't count."""
    hashes, own, owner, line, begins, sizes = lines
    short = sizes < min_words
    starts = np.ones(len(line), bool)
    if short.any():
        run = np.cumsum(np.append(True, (owner[1:] != owner[:-1]) | ~short[1:] | ~short[:-1]))[short]
        marks = mixed(np.add.reduceat(hashes, begins))[short]
        starts[short] = _starts(run, begins[short], sizes[short], marks, min_words)
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], len(line))
    total = np.add.reduceat(sizes, at) if len(at) else sizes
    kept = total >= min_words
    at, last, sizes = at[kept], ends[kept] - 1, total[kept]
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    words = np.repeat(begins[at] - ends[:-1], sizes) + np.arange(ends[-1])
    return owner[at], line[at], line[last], begins[at] - own[owner[at]], hashes[words], ends


def min_hashes(shingles: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands x sets: keys of sets of shingle hashes that lie one after the other."""
    begins = np.cumsum(sizes) - sizes
    seeds = mixed(np.arange(2 * bands * rows, dtype=np.uint64) + np.uint64(1 << 40))
    keys = np.zeros((bands, len(sizes)), np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat(shingles * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1], begins)
        keys[k // rows] = mixed(keys[k // rows] + least)
    return mixed(keys + np.arange(bands, dtype=np.uint64)[:, None])


#: Columns of a text as a whole, null in the rows of its paragraphs.
WHOLE = ["bare", "n", "d1", "d2", "lines", "starts", "spots", "prints"]


def _features(documents: DataFrame, width: int, min_words: int, bands: int, rows: int, length: int) -> DataFrame:
    """A row for each paragraph: key, text_hash, doc, line, last, begin, words, f1, f2, keys; and one with a null line for each
    text: bare (it has no paragraph) and what `passages.repeated` needs."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in pieces(batch.column("text").to_pylist()):
                lines = _lines(texts)
                owner, line, last, begin, hashes, ends = _paragraphs(lines, min_words)
                held = list(shingle_hashes(hashes, ends, width))
                sizes = np.array([len(x) for x in held], np.int64)
                flat = np.concatenate(held) if held else np.zeros(0, np.uint64)
                if held:
                    prints = [np.add.reduceat(mixed(flat + np.uint64(s)), np.cumsum(sizes) - sizes).astype(np.int64) for s in (1, 2)]
                    keys = packed(list(min_hashes(flat, sizes, bands, rows).T.copy()))
                    yield _record(batch, begun + owner, schema, line=line, last=last, begin=begin, words=np.diff(ends), f1=prints[0], f2=prints[1], keys=keys)
                bare = np.ones(len(texts), bool)
                bare[owner] = False
                yield _record(batch, begun + np.arange(len(texts)), schema, bare=bare, **_whole(lines, length))

    kind = documents.schema["key"].dataType.simpleString()
    schema = {"line": pa.int64(), "last": pa.int64(), "begin": pa.int64(), "words": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "keys": pa.list_(pa.int64()),
              "bare": pa.bool_(), "n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "lines": pa.list_(pa.int32()),
              "starts": pa.list_(pa.int32()), "spots": pa.list_(pa.int32()), "prints": pa.list_(pa.int64())}
    return in_arrow(documents, features, f"key {kind}, text_hash long, doc long, line long, last long, begin long, words long, f1 long, f2 long, "
                    "keys array<long>, bare boolean, n long, d1 long, d2 long, lines array<int>, starts array<int>, spots array<int>, prints array<long>")


def _whole(lines: tuple[np.ndarray, ...], length: int) -> dict:
    """The columns of WHOLE, but for bare, of each text."""
    hashes, own, owner, line, begins, _ = lines
    spots, prints = winnowed(hashes, own, length)
    by_line, by_spot = np.searchsorted(owner, np.arange(len(own))), np.searchsorted(spots, own)

    def lists(values: np.ndarray, ends: np.ndarray, kind: type) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(kind)))

    def within(places: np.ndarray) -> np.ndarray:
        return places - own[np.searchsorted(own, places, "right") - 1]

    d1, d2 = (run_hashes(x, own[:-1], own[1:]).view(np.int64) for x in (hashes, mixed(hashes + np.uint64(1))))
    return {"n": np.diff(own), "d1": d1, "d2": d2, "lines": lists(line, by_line, np.int32), "starts": lists(within(begins), by_line, np.int32),
            "spots": lists(within(spots), by_spot, np.int32), "prints": lists(prints.view(np.int64), by_spot, np.int64)}


def _record(batch: pa.RecordBatch, owner: np.ndarray, schema: dict, **columns) -> pa.RecordBatch:
    own = [batch.column(x).take(pa.array(owner)) for x in ("key", "text_hash", "doc")]
    rest = [pa.nulls(len(owner), t) if (x := columns.get(c)) is None else pa.array(x, t) if isinstance(x, np.ndarray) else x for c, t in schema.items()]
    return pa.RecordBatch.from_arrays([*own, *rest], ["key", "text_hash", "doc", *schema])


def _sets(rows: DataFrame, width: int, min_words: int) -> DataFrame:
    """id, family, n, set of rows text, wanted (array of line, id, family)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            for begun, texts in pieces(batch.column("text").to_pylist()):
                owner, line, _, _, hashes, ends = _paragraphs(_lines(texts), min_words)
                place = {x: k for k, x in enumerate(zip(owner.tolist(), line.tolist(), strict=True))}
                held = list(shingle_hashes(hashes, ends, width))
                out = [(x["id"], x["family"], np.unique(held[place[k, x["line"]]]))
                       for k in range(len(texts)) for x in wanted[begun + k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                     pa.array([len(x[2]) for x in out], pa.int64()), pa.array([x[2].tobytes() for x in out], pa.binary())],
                    ["id", "family", "n", "set"])

    return in_arrow(rows, sets, "id long, family long, n long, set binary")


def paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
               min_words: int = 25, rows: int = 4, missed: float = 0.001, length: int = 50) -> DataFrame:
    """A row for each paragraph, and one with a null line for a document without any: key, text_hash, doc (number of the
    input row), line (its first, from 0), last (its last line), begin (first word, from 0), words, cluster, n_in_cluster, first_key, removed. Then one for
    each repeated passage, with a null line and cluster: also taken (lines of which no word is left) and others (keys of
    the documents that keep the document's passages).

    Paragraphs are similar if their sets of `width`-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lowered) have a
    Jaccard similarity of `percent` % or more; clusters are the components. The cluster's first paragraph, by key, text
    and line, stays, and all others are removed; cluster, n_in_cluster and first_key are null for a paragraph that is
    like no other. `rows` and `missed` tune the bands: of the pairs right at the similarity, at most `missed` are not
    compared; of more similar pairs less.

    A passage is a run of `length` words or more, wherever it begins and whatever lines it crosses, that occurs before by
    key, text and place; all its occurrences but the first are removed, exactly (by 64-bit hashes of `length` words).

    Rows with the same key and text are one document, whose paragraphs have the same fate in each row. Null and empty
    texts have no paragraph. A null key is a key, sorted first. Other columns are not looked at. Needs the shared folder.
    """
    bands = tuned_bands(percent, rows, missed)
    given = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    found = _features(given.withColumn("doc", F.monotonically_increasing_id()), width, min_words, bands, rows, length)
    found = landed(found.withColumn("id", F.monotonically_increasing_id()))
    real = found.where("line IS NOT NULL")
    place = F.struct("key", "text_hash", "line")
    # most paragraphs are like no other: only those that may have an equal are put into classes, only the others' keys go on
    again = repeated_hashes(real, "f1", found)
    equal = sifted(real.select("id", "f1", "f2", place.alias("place")), short(F.col("f1")), sieve(again, "hash")).where("_may")
    classes = landed(equal.groupBy("f1", "f2").agg(F.min("id").alias("first"), F.min("place").alias("place"), F.count(F.lit(1)).alias("n")).where("n > 1"), found)
    copies = landed(within(real.select("id", "f1", "f2"), classes.select("f1", "f2", "first"), "f1", "f2").where("id <> first").select("id"), found)
    single = without(real.select("id", "keys"), copies, "id")
    near = families(single.select("id", F.explode(F.array_distinct("keys")).alias("key")), found)
    keyed, found = found, landed(found.drop("keys"), found)  # half of what is stored is keys, which no later step reads
    real = found.where("line IS NOT NULL")
    dropped(keyed, again)
    wanted = landed(within(real.select("id", "key", "text_hash", "line"), near, "id").groupBy("key", "text_hash").agg(
        F.collect_list(F.struct("line", "id", "family")).alias("wanted")), found)
    # only texts that the sieve lets through are shuffled to their partners
    let = told(given, wanted, "key", "text_hash").where("_may")
    texts = let.join(wanted, let["key"].eqNullSafe(wanted["key"]) & (let["text_hash"] == wanted["text_hash"]))
    members = landed(_sets(texts.select("text", "wanted"), width, min_words))
    components = similar_components(members, percent)
    linked = landed(components, found)
    tied = classes.join(linked.withColumnRenamed("id", "first"), "first", "left").withColumn("cluster", F.coalesce("component", "first"))
    # a paragraph without an equal that is linked stands for itself
    others = landed(without(linked, classes.select(F.col("first").alias("id")), "id"), found)
    lone = within(real.select("id", "f1", "f2", place.alias("place")), others, "id")
    lone = lone.withColumn("n", F.lit(1).cast("long")).withColumnRenamed("component", "cluster")
    tied = landed(tied.select("f1", "f2", "place", "n", "cluster").unionByName(lone.drop("id")), found)
    clusters = landed(tied.groupBy("cluster").agg(F.min("place").alias("kept"), F.sum("n").alias("n_in_cluster")).where("n_in_cluster > 1"), found)
    tied = landed(tied.join(clusters, "cluster").select("f1", "f2", "cluster", "kept", "n_in_cluster"), found)
    dropped(copies, near, wanted, members, components, linked, others, classes, clusters)
    passages = repeated(found.where("line IS NULL").select("key", "text_hash", "doc", *WHOLE), given, length, found)
    joined = beside(found.where("line IS NOT NULL OR bare").drop(*WHOLE), tied, "f1", "f2")
    report = joined.select("key", "text_hash", "doc", "line", "last", "begin", "words", "cluster", "n_in_cluster", F.col("kept.key").alias("first_key"),
                           F.coalesce(F.col("kept") != place, F.lit(False)).alias("removed"))
    return report.unionByName(passages.withColumn("removed", F.lit(True)), allowMissingColumns=True)


def _union(spans: Column) -> Column:
    """How many words the spans (begin, words) take together."""
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("size"))
    return F.aggregate(F.sort_array(spans), none, lambda a, x: F.struct(
        F.greatest(a["end"], x["begin"] + x["words"]).alias("end"),
        (a["size"] + F.greatest(F.lit(0).cast("long"), x["begin"] + x["words"] - F.greatest(a["end"], x["begin"]))).alias("size")), lambda a: a["size"])


def document_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document of `paragraphs`: key, n_paragraphs, n_repeated (paragraphs in a cluster with others),
    n_removed (paragraphs and passages), words_removed, removed_lines (with those that passages take whole), same_as (keys
    of the documents that keep what is removed), passages (the removed ones: begin, words)."""
    repeated = F.col("n_in_cluster").isNotNull()
    lines = F.coalesce("taken", F.sequence("line", "last"))
    keepers = F.array_compact(F.coalesce("others", F.array("first_key")))
    return found.groupBy("doc").agg(
        F.first("key").alias(key), F.count("line").alias("n_paragraphs"), F.count_if(repeated).alias("n_repeated"),
        F.count_if("removed").alias("n_removed"),
        _union(F.collect_list(F.when(F.col("removed"), F.struct("begin", "words")))).alias("words_removed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("removed"), lines))))).alias("removed_lines"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("removed"), keepers))))).alias("same_as"),
        F.sort_array(F.collect_list(F.when(F.col("removed") & F.col("line").isNull(), F.struct("begin", "words")))).alias("passages")).drop("doc")


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, without their removed paragraphs and passages; what is left without a word goes.

    Takes the options of `paragraphs`. A document that had no word before stays as it is.
    """
    found = paragraphs(documents, key, text, **options).where("removed")
    span = F.when(F.col("line").isNull(), F.struct("begin", (F.col("begin") + F.col("words")).alias("end")))
    gone = landed(found.groupBy("key", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("line", "last")))).alias("gone"), F.collect_set(span).alias("spans")))
    dropped(found)
    others = [c for c in documents.columns if c != text]
    rows = documents.select(
        F.struct(*others).alias("document"), F.col(text).alias("body"), F.col(key).alias("own"), F.xxhash64(text).alias("own_hash"))
    hashes = gone.select(F.xxhash64("key", "text_hash").alias("hashed"))
    rows = sifted(rows, F.xxhash64("own", "own_hash"), sieve(hashes, "hashed"))
    columns = [F.col("body").alias(c) if c == text else F.col(f"document.{c}") for c in documents.columns]
    safe = rows.where(~F.col("_may")).select(*columns)
    joined = rows.where("_may").join(gone, F.col("own").eqNullSafe(F.col("key")) & (F.col("own_hash") == F.col("text_hash")), "left")
    joined = joined.select("document", "body", "gone", "spans")
    joined = in_arrow(joined, _without_spans, StructType([*joined.schema.fields[:3], StructField("rest", StringType())]))
    lines = F.array_join(F.filter(F.split("body", "\n"), lambda _, i: ~F.array_contains("gone", i.cast("long"))), "\n")
    left = joined.withColumn("rest", F.coalesce("rest", lines))
    left = left.where(F.col("gone").isNull() | F.col("rest").rlike(r"[^\x20\x09-\x0D]"))
    return safe.union(left.withColumn("body", F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.col("rest"))).select(*columns))


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """document, body, gone, and rest: what `cut` leaves of a body with a passage to lose; null for the others."""
    for batch in batches:
        for begun, texts in pieces(batch.column("body").to_pylist()):
            part = batch.slice(begun, len(texts))
            gone, spans = (part.column(c).to_pylist() for c in ("gone", "spans"))
            rest = [cut(x, g, [(s["begin"], s["end"]) for s in p]) if p else None for x, g, p in zip(texts, gone, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("document", "body", "gone")), pa.array(rest, pa.string())], ["document", "body", "gone", "rest"])
