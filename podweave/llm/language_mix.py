"""Language identification by mixture inference.

Character trigrams inside words are counted for each language over all documents that may be learned from. A document
is taken as a mixture: every word has a likelihood under each language, and expectation-maximisation finds the shares.
Which languages take part is decided by penalised likelihood: sets of the likeliest languages, from one upwards, are
fitted anew, and a larger set must pay for its extra share.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from podweave.llm.byte_bpe import LETTER, character_kinds
from podweave.llm.landing import in_arrow
from podweave.llm.textarrays import PIECE, codepoints, mixed, pieces

#: The model has 2^BITS buckets for each language. It is sent to every task (256 kB a language), so more than so many
#: languages are an error; none is ever left out.
BITS, MOST_LANGUAGES = 15, 2048

#: Numbers, letters or words by languages, that are held at once, unless one text by itself has more.
CELLS = 1 << 22

#: Steps of expectation-maximisation for all languages, and for each smaller set.
STEPS = 8


@functools.cache
def _lowered() -> np.ndarray:
    """The lower case of each code point that has one of a single character."""
    table = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        if len(low := chr(point).lower()) == 1:
            table[point] = ord(low)
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, first trigram of each word, text of each word); words are runs of
    letters, and what is no letter counts as the same mark before and after them."""
    points, at = codepoints(texts)
    letter = character_kinds(points) == LETTER
    plain = np.zeros(len(points) + 2, np.uint64)
    plain[1:-1] = np.where(letter, _lowered()[points], 0)
    spots = np.flatnonzero(letter)
    a, b, c = (mixed(np.uint64(k << 32) + plain[spots + k]) for k in range(3))
    buckets = ((a + b + c) >> np.uint64(64 - BITS)).astype(np.int64)
    words = np.flatnonzero(np.append(True, np.diff(spots) > 1)) if len(spots) else np.zeros(0, np.int64)
    return buckets, words, np.searchsorted(at, spots[words], "right") - 1


def learned(documents: DataFrame, text: str = "text", language: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order of their names, log probability of each bucket under each), from all documents with a language.

    Each task sends at most one row for a language and bucket; the driver gets the finished counts, 2^BITS for each language
    at most, as Arrow. One count is added to every bucket. Over MOST_LANGUAGES languages are a ValueError.
    """
    rows = documents.where(F.col(language).isNotNull()).select(F.col(text).alias("text"), F.col(language).alias("lang"))
    names = sorted(x[0] for x in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; map them to fewer before learning")
    place = {x: k for k, x in enumerate(names)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for begun, texts in pieces(batch.column("text").to_pylist()):
                buckets, words, owner = trigrams(texts)
                of_text = np.array([place.get(x, -1) for x in langs[begun: begun + len(texts)]])
                of_letter = np.repeat(of_text[owner], np.diff(np.append(words, len(buckets))))
                for k in np.unique(of_letter[of_letter >= 0]).tolist():
                    found = np.bincount(buckets[of_letter == k], minlength=1 << BITS)
                    counts[k] = counts[k] + found if k in counts else found
        for k, found in counts.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k)), pa.array(used), pa.array(found[used])], ["lang", "bucket", "n"])

    sums = in_arrow(rows, counted, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    totals = np.ones((len(names), 1 << BITS))
    found = sums.toArrow()
    totals[found.column("lang").to_numpy(), found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return names, np.log(totals / totals.sum(axis=1, keepdims=True))


def _shares(likely: np.ndarray, allowed: np.ndarray, weights: np.ndarray, first: np.ndarray, size: np.ndarray, steps: int):
    """Shares of the allowed languages in each text, by expectation-maximisation, and the log likelihood up to a constant.

    likely: words x languages, scaled to a maximum of 1; weights: letters of each word; first and size: words of each text.
    """
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(weights, first)[:, None]
    for _ in range(steps):
        joint = likely * np.repeat(shares, size, axis=0)
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        shares = np.add.reduceat(joint * weights[:, None], first, axis=0) / total
    chance = np.maximum((likely * np.repeat(shares, size, axis=0)).sum(axis=1), 1e-300)
    return shares, np.add.reduceat(np.log(chance), first)


def _word_logs(buckets: np.ndarray, words: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Log likelihood of each word under each language, some letters at a time."""
    most = max(1, CELLS // len(model))
    cuts = np.unique(np.append(np.searchsorted(words, np.arange(0, len(buckets), most)), len(words)))
    ends = np.append(words, len(buckets))
    return np.concatenate([np.add.reduceat(model.T[buckets[words[a]: ends[b]]], words[a:b] - words[a], axis=0)
                           for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def infer(texts: list[str], model: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(texts with a letter, shares of the languages in each): languages outside the chosen set have a share of 0.

    A set of m languages pays `penalty` * (m - 1) / 2 * log(words): the Bayesian information criterion at 1.
    """
    buckets, words, owner = trigrams(texts)
    if not len(words) or not len(model):
        return np.zeros(0, np.int64), np.zeros((0, len(model)))
    known, first, size = np.unique(owner, return_index=True, return_counts=True)
    logs = _word_logs(buckets, words, model)
    likely = np.exp(logs - logs.max(axis=1, keepdims=True))
    weights = np.diff(np.append(words, len(buckets))).astype(float)
    everything = np.ones((len(known), len(model)))
    shares, _ = _shares(likely, everything, weights, first, size, STEPS)
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1)
    best, chosen = np.full(len(known), -np.inf), shares
    open_ = np.ones(len(known), bool)
    for m in range(1, len(model) + 1):
        fitted, value = _shares(likely, (rank < m).astype(float), weights, first, size, STEPS if m > 1 else 1)
        value -= penalty * (m - 1) / 2 * np.log(size + 1)
        better = open_ & (value > best)
        chosen = np.where(better[:, None], fitted, chosen)
        best = np.where(better, value, best)
        open_ = better  # once a further language doesn't pay, the next, of a smaller share, isn't tried
        if not open_.any():
            break
    return known, chosen


def identify(documents: DataFrame, names: list[str], model: Broadcast, text: str = "text", penalty: float = 1.0) -> DataFrame:
    """All columns, then lang_pred (the language of the largest share, `und` if the text is null or has no letter, or
    nothing was learned), score (its share, 0 to 1) and languages (all that take part, the largest share first).
    Input columns of these names are replaced; nothing but the text decides."""
    kept = documents.drop("lang_pred", "score", "languages")

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, texts in pieces(batch.column(text).to_pylist(), max(1 << 10, min(PIECE, CELLS // max(1, len(names))))):
                known, shares = infer(texts, model.value, penalty)
                told = [("und", 0.0, [])] * len(texts)
                order = np.argsort(-shares, axis=1, kind="stable")
                for k, share, places in zip(known.tolist(), shares, order, strict=True):
                    told[k] = names[places[0]], min(1.0, float(share[places[0]])), [names[p] for p in places if share[p] > 0.001]
                part = batch.slice(begun, len(texts))
                columns = [pa.array(x, t) for x, t in zip(zip(*told, strict=True), (pa.string(), pa.float64(), pa.list_(pa.string())), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "lang_pred", "score", "languages"])

    return in_arrow(kept, identified, StructType([
        *kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("languages", ArrayType(StringType()))]))


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is held out of learning: the CRC-32 of its key as text is 2 modulo 4; never without key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def language_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang",
                 penalty: float = 1.0) -> DataFrame:
    """One row per input row: key, held_out, lang_pred, score, languages.

    Learns from text and language of the documents that have both a key and a language and are not held out. See
    `identify`. Repeated rows fare alike; a null language is not learned; extra columns are not looked at.
    """
    given = documents.select(F.col(key).alias(key), F.col(text).alias(text), F.col(language).alias(language), held_out(key).alias("held_out"))
    names, model = learned(given.where(~F.col("held_out") & F.col(key).isNotNull()), text, language)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return identify(given.select(key, "held_out", text), names, shared, text, penalty).drop(text)
