"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (labelled good) and one of the raw corpus, give every
document the log of its importance weight: the sum, over its n-grams, of the log ratio of both probabilities. What is
sampled by is the mean of these, or long texts would outweigh all others, divided by a temperature. Adding Gumbel noise
and taking the k largest samples k documents by weight without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from podweave.llm.byte_bpe import GAP, LETTER, NUMBER, character_kinds
from podweave.llm.landing import dropped, in_arrow, landed
from podweave.llm.textarrays import codepoints, mixed, pieces, slice_hashes

#: The models have 2^BITS buckets; this, and nothing that grows with the corpus, is what is sent to the tasks.
BITS = 16

#: N-grams of the mean weight that every text is taken to have besides its own: a few words prove little.
PRIOR = 50

#: Noise of size 1 meets scores divided by this: documents within about as much of the k-th score are in by chance.
TEMPERATURE = 0.05

#: Counters of one pass of the search for the k-th largest key.
BINS = 4096


def ngram_buckets(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens (runs of letters and digits, runs of other visible characters) and of neighbouring tokens,
    text by text, and where each text's begin (one more entry at the end)."""
    points, at = codepoints(texts)
    empty = np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    if not len(points):
        return empty
    kinds = character_kinds(points)
    kinds[kinds == NUMBER] = LETTER
    gap = kinds == GAP
    gap[at[1:-1] - 1] = True
    begins = ~gap
    begins[1:] &= gap[:-1] | (kinds[1:] != kinds[:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return empty
    hashes = slice_hashes(points, gap, starts, False)
    first = np.searchsorted(starts, at)
    pairs = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    pairs[hashes[:-1] == hashes[1:]] = 0  # a token said twice is one and the same n-gram, whatever the token
    owner = np.searchsorted(at, starts, "right")
    both = np.concatenate((hashes, pairs[owner[1:] == owner[:-1]]))
    owners = np.concatenate((owner, owner[:-1][owner[1:] == owner[:-1]])) - 1
    order = np.argsort(owners, kind="stable")
    return (both[order] >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(owners[order], np.arange(len(texts) + 1))


def labelled_sample(labels: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """labelled (the key), good (1: quality and not toxic, 0: no quality), fits (whether the target model may learn from
    it; the cut is set on the others): at most `most` labelled documents, drawn by hash of the key.

    Of repeated labels the larger values count; toxic documents of quality and rows without key or quality are left out.
    """
    each = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    known = each.where((F.col("quality") == 0) | (F.col("quality") == 1) & (F.col("toxic") == 0))
    return known.select(F.col("key").alias("labelled"), F.col("quality").cast("int").alias("good"),
                        (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2)) == 0).alias("fits")).orderBy(F.xxhash64("labelled"), "labelled").limit(most)


def fit(documents: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of the probabilities of each bucket under the target (good documents of the sample) and the raw model
    (all documents), each with one count added to every bucket. Without any target text all are 0."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # the sample's size is bounded by its parameter
    rows = rows.join(F.broadcast(sample), F.col("key") == F.col("labelled"), "left").select(
        "text", F.coalesce((F.col("good") == 1) & F.col("fits"), F.lit(False)).alias("target"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            of_target = batch.column("target").to_numpy(zero_copy_only=False)
            for begun, texts in pieces(batch.column("text").to_pylist()):
                buckets, first = ngram_buckets(texts, BITS)
                counts[0] += np.bincount(buckets, minlength=1 << BITS)
                target = np.repeat(of_target[begun: begun + len(texts)], np.diff(first))
                counts[1] += np.bincount(buckets[target], minlength=1 << BITS)
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x[used]) for x in counts)], ["bucket", "raw", "target"])

    sums = in_arrow(rows, counted, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(1 << BITS), np.ones(1 << BITS)
    for bucket, r, t in sums.collect():  # 2^BITS rows at most
        raw[bucket] += r
        target[bucket] += t
    if target.sum() == len(target):
        return np.zeros(1 << BITS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(documents: DataFrame, model: Broadcast, text: str = "text") -> DataFrame:
    """All columns, then n_ngrams and log_weight: the sum of the model's log ratios over the text's n-grams. Columns of
    these names are replaced. A text without n-grams has weight 0 and is told by its n_ngrams."""
    kept = documents.drop("n_ngrams", "log_weight")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in pieces(batch.column(text).to_pylist()):
                buckets, first = ngram_buckets(texts, BITS)
                sums = np.concatenate(([0.0], np.cumsum(model.value[buckets])))
                part = batch.slice(begun, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]])],
                    [*part.schema.names, "n_ngrams", "log_weight"])

    return in_arrow(kept, weighed, StructType(
        [*kept.schema.fields, StructField("n_ngrams", LongType()), StructField("log_weight", DoubleType())]))


def mean_weight() -> Column:
    """Log weight to an n-gram, shrunk towards 0 for short texts; null without n-grams."""
    return F.when(F.col("n_ngrams") > 0, F.round(F.col("log_weight") / (F.col("n_ngrams") + PRIOR), 9))


def gumbel_key(weight: Column, drawn_by: Column, temperature: float, seed: int | Column) -> Column:
    """Log weight by temperature, plus standard Gumbel noise drawn by hash of `drawn_by`: the k rows of the largest keys are
    a sample without replacement, each next one drawn in proportion to exp(weight / temperature)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), drawn_by), 11).cast("double") + 0.5) / float(1 << 53)
    return weight / temperature - F.ln(-F.ln(u))


def best_cut(scores: list[float], good: list[int]) -> float:
    """The middle of the gap at which most is gained: share of the good above it less share of the others above it."""
    order = np.argsort(scores, kind="stable")
    values, marks = np.asarray(scores, float)[order], np.asarray(good)[order]
    if not (marks == 1).any() or not (marks == 0).any():
        return -np.inf
    lost = np.concatenate(([0], np.cumsum(marks == 1))) / (marks == 1).sum()
    gained = np.concatenate(([0], np.cumsum(marks == 0))) / (marks == 0).sum()
    at = int(np.argmax(gained - lost))
    return float(values[0] - 1 if at == 0 else values[-1] + 1 if at == len(values) else (values[at - 1] + values[at]) / 2)


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column without null or NaN (k from 1 to its count), exactly: the range is cut into
    bins, their counts tell the bin of the k-th, and that bin is cut again until it holds few rows or one value."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        inside = rows.where(F.col(column).between(low, high))
        step = (high - low) / BINS
        bin_ = F.least(F.floor((F.col(column) - low) / F.lit(step)), F.lit(BINS - 1)) if step > 0 else F.lit(0).cast("long")
        bins = inside.groupBy(bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for found in bins:
            if found["n"] >= k:
                break
            k -= found["n"]
        low, high = found["low"], found["high"]
        if found["n"] <= BINS:
            held = rows.where(F.col(column).between(low, high)).select(column).orderBy(F.desc(column)).limit(k).collect()
            return held[-1][0]
    return low


class Resampling:
    """A fitted model with the key that the last sampled document has."""

    def __init__(self, model: Broadcast, cut: float, least: float | None, k: int, total: int):
        self.model, self.cut, self.least, self.k, self.total = model, cut, least, k, total


def _keyed(rows: DataFrame, key: str, text: str, temperature: float, seed: int) -> DataFrame:
    drawn_by = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), text))  # without a key the text draws
    return rows.withColumn("score", mean_weight()).withColumn("gumbel_key", gumbel_key(F.col("score"), drawn_by, temperature, seed))


def resampling(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most_labels: int = 20_000,
               temperature: float = TEMPERATURE, seed: int = 7, k: int | None = None, fraction: float | None = None,
               label_key: str = "doc_id") -> tuple[Resampling, DataFrame]:
    """The fitted resampling, and the stored scores: key, n_ngrams, log_weight, score, gumbel_key.

    Target model and cut are fitted on a sample of at most `most_labels` labelled documents, each on its own half, so
    that the cut holds for documents the target model has not seen; the raw model is fitted on all documents. The k
    documents of the largest Gumbel keys are sampled; k is given, or as a fraction of the documents with a score, or is
    the number of those whose score is above the cut. Of repeated rows of a labelled key the least score sets the cut.
    """
    sample = landed(labelled_sample(labels, most_labels, label_key))
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, sample, key, text))
    scores = landed(_keyed(weigh(documents.select(F.col(key).alias(key), F.col(text).alias(text)), model, text), key, text, temperature, seed).drop(text))
    known = scores.join(F.broadcast(sample), F.col(key) == F.col("labelled")).where("score IS NOT NULL AND NOT fits")
    known = known.groupBy("labelled").agg(F.min("score").alias("score"), F.max("good").alias("good")).orderBy("labelled")
    known = known.select("score", "good").collect()  # one row for each of the sample's documents at most
    cut = best_cut([x[0] for x in known], [x[1] for x in known])
    total, above = scores.where("score IS NOT NULL").agg(F.count(F.lit(1)), F.count_if(F.col("score") > cut)).first()
    if k is None:
        k = above if fraction is None else round(fraction * total)
    k = max(0, min(k, total))
    least = kth_largest(scores.where("score IS NOT NULL"), "gumbel_key", k) if k else None
    dropped(sample)
    return Resampling(model, cut, least, k, total), scores


def _kept(found: Resampling) -> Column:
    if found.least is None:
        return F.lit(False)
    return F.coalesce(F.col("gumbel_key") >= found.least, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: key, n_ngrams, log_weight, score, gumbel_key, kept. Takes the options of `resampling`.

    A text without visible characters, or null, has no score and is not kept. Without labels of both kinds, or without
    labels at all, every text is kept, unless k or a fraction is given. The noise of a row without key is drawn by its
    text; repeated rows fare alike, and rows that tie with the last one are kept with it. Extra columns are not looked at.
    Needs the shared folder.
    """
    found, scores = resampling(documents, labels, key, text, **options)
    return scores.withColumn("kept", _kept(found))


def classified(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", temperature: float = TEMPERATURE,
               seed: int = 7, **options) -> DataFrame:
    """The documents that `classify` keeps, all columns. Each row is weighed again as it is written, so nothing is joined."""
    found, scores = resampling(documents, labels, key, text, temperature=temperature, seed=seed, **options)
    dropped(scores)
    columns = documents.columns
    named = documents.select(F.struct(*columns).alias("document"), F.col(key).alias("key"), F.col(text).alias("text"))
    weighed = _keyed(weigh(named, found.model), "key", "text", temperature, seed)
    return weighed.where(_kept(found)).select(*(F.col(f"document.{c}") for c in columns))
