"""Quality rules: repetition inside a document, and lines that too many documents of a host share.

Native expressions only. Documents are read once; per document a narrow row of counts and line hashes is stored, and
all counting across documents works on that: lines are pre-aggregated before the shuffle, so a line that a third of all
documents carry arrives as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podweave.llm.landing import landed

#: A word, and the symbols that are counted.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def normalised_line(line: Column) -> Column:
    """Lower case, one space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def _line_keys(lines: Column, host: Column) -> Column:
    """Hash of each line with its host; null for a line without a word."""
    return F.transform(lines, lambda x: F.when(F.length(normalised_line(x)) > 0, F.xxhash64(host, normalised_line(x))))


def _windows(words: Column) -> Column:
    """(hash, position) of every window of three words, sorted."""
    last = F.size(words) - 3
    spots = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(spots, lambda i: F.struct(
        F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))))


def _covered(windows: Column) -> Column:
    """Words that lie in a window found twice or more, each counted once."""
    twice = F.filter(windows, lambda x, k: (F.try_element_at(windows, k + 2)["h"] == x["h"])
                     | ((k > 0) & (F.get(windows, k - 1)["h"] == x["h"])))
    spots = F.sort_array(F.transform(twice, lambda x: x["i"]))
    return F.aggregate(
        spots, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + (i + 3 - F.greatest(s["end"], i))).alias("n")),
        lambda s: s["n"])


def document_counts(documents: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Per row: its key, the base counts, and hash and number of words of each of its lines.

    word_chars: code points in words; n_symbols: symbol characters; n_dup_lines: lines with a word that equal an earlier
    line; n_repeat_words: words in three-word windows that occur twice or more in the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    staged = documents.select(
        F.col(key).alias("key"), F.col(host).alias("host"), body.alias("body"),
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("words"), F.split(body, "\n").alias("lines"))
    staged = staged.select(
        "key", "body", F.size("words").cast("long").alias("n_words"), _windows(F.col("words")).alias("windows"), "lines",
        _line_keys(F.col("lines"), F.col("host")).alias("line_keys"),
        F.filter("lines", lambda x: x.rlike(WORD)).alias("full"))
    return staged.select(
        "key", "n_words",
        F.length(F.regexp_replace("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("windows")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("line_words"), "line_keys")


def frequent_lines(counts: DataFrame, max_documents: int) -> DataFrame:
    """line_key, n_documents of the lines that more than `max_documents` documents of their host contain."""
    lines = counts.select(F.explode(F.array_distinct("line_keys")).alias("line_key")).where("line_key IS NOT NULL")
    return lines.groupBy("line_key").agg(F.count(F.lit(1)).alias("n_documents")).where(F.col("n_documents") > max_documents)


def judge(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_documents: int = 20,
          max_removed_percent: int = 50, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per input row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
    removed_lines (their positions from 0), base_failed, kept.

    base_failed: fewer than `min_words` words, or over `max_repeat_percent` of them in repeated three-word windows.
    Lines (case and spacing aside) that more than `max_documents` documents of one host contain are removed; a document
    that loses more than `max_removed_percent` of its words by this is depleted. kept: neither failed nor depleted.

    A null text is empty: no words, base_failed. A null host is a host of its own. Every row is a document, repeated rows
    and rows without key included. Other columns are not looked at. Needs the shared folder.
    """
    counts = landed(document_counts(documents, key, text, host).withColumn("row", F.monotonically_increasing_id()))
    frequent = landed(frequent_lines(counts, max_documents))
    lines = counts.select("row", F.posexplode(F.arrays_zip("line_keys", "line_words")).alias("line", "x")).select(
        "row", "line", F.col("x.line_keys").alias("line_key"), F.col("x.line_words").alias("words"))
    removed = lines.join(frequent, "line_key", "left_semi").groupBy("row").agg(
        F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_list("line")).alias("removed_lines"))
    judged = counts.drop("line_keys", "line_words").join(removed, "row", "left")
    lost = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        lost.alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
        failed.alias("base_failed"), (~failed & (100 * lost <= max_removed_percent * F.col("n_words"))).alias("kept"))


def without_lines(documents: DataFrame, judged: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that `judge` keeps, all columns, with the lines it removes cut out of their text. Needs unique keys."""
    found = judged.where("kept").select(F.col(key).alias("key"), "removed_lines")
    rows = documents.select(F.struct(*documents.columns).alias("document"), F.col(key).alias("own"))
    joined = rows.join(found, F.col("own").eqNullSafe(F.col("key")))
    rest = F.filter(F.split(F.col(f"document.{text}"), "\n"), lambda _, i: ~F.array_contains("removed_lines", i))
    return joined.select(*(F.array_join(rest, "\n").alias(c) if c == text else F.col(f"document.{c}") for c in documents.columns))
