"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Native expressions only. Every document gets the key -ln(u) / weight; taken in the order of this key, documents form a
weighted sample without replacement. A source's target is made of complete epochs first; the rest is a prefix of its
documents in key order. The prefix is found in two steps, so that no task sorts a whole source: sums over equal slices
of the keys' range tell in which slice the budget ends, and only that slice is sorted and summed up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podweave.llm.landing import landed
from podweave.llm.quality_rules import SYMBOLS, WORD

#: The sources' weights, by turns in the order of their names.
SHARES = (5, 2, 1)

#: Documents a slice holds on average; the fullest holds as many times more as the largest weight exceeds the smallest.
SLICE = 2000


def quality_weight(text: Column, size: Column) -> Column:
    """4 for a text without symbols, down to 1 for one with a symbol or more to each word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.lit(1.0) + F.lit(3.0) * (F.lit(1.0) - F.least(F.lit(1.0), symbols.cast("double") / F.greatest(size, F.lit(1))))


def sampling_key(key: Column, text: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the MD5 of seed and key, or without key of seed and text: the same on every
    run and machine."""
    own = F.coalesce(key.cast("string"), F.concat(F.lit("~"), F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), own)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def targets(totals: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size, n_documents, target: shares of all sizes by turns of SHARES, none over `most` times its size.

    What a capped source leaves is shared by the others by weight. Sorted by size to weight, the capped sources come
    first; each is capped if an equal share of what is left after those before it exceeds its cap. One row per source.
    """
    share = F.element_at(F.array(*map(F.lit, SHARES)), ((F.col("place") - 1) % len(SHARES) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    rows = totals.withColumn("place", F.row_number().over(by_name)).withColumn("share", share.cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("share"))
    rows = rows.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - (F.sum("cap").over(by_ratio) - F.col("cap")))
    rows = rows.withColumn("level", F.col("left") / F.sum("share").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("capped", F.col("ratio") <= F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct("ratio", "place", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("final", final).select(
        "source", "source_size", "n_documents",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("share")).alias("target"))


def _sized(documents: DataFrame, key: str, text: str, source: str, weight: Column | None, seed: str) -> DataFrame:
    """document (all columns as one), key, source, _size, _weight, _sample."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select(
        F.struct(*documents.columns).alias("document"), F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"),
        size.alias("_size"), (weight if weight is not None else F.lit(None).cast("double")).alias("_given"))
    given = F.col("_given") if weight is not None else quality_weight(F.col("text"), F.col("_size"))
    rows = rows.withColumn("_weight", F.coalesce(given, F.lit(1.0)))
    return rows.withColumn("_sample", sampling_key(F.col("key"), F.col("text"), F.col("_weight"), seed)).drop("text", "_given")


def _slice(lightest: str = "lightest", slices: str = "slices") -> Column:
    """The slice of a key: the range (0, 1) of the lightest document's distribution function in equal parts."""
    return F.floor((F.lit(1.0) - F.exp(-F.col("_sample") * F.col(lightest))) * F.col(slices))


def mix_plan(rows: DataFrame, most: int = 3) -> DataFrame:
    """Per source: source_size, target, epochs, slices, lightest, and where its prefix ends (cut_slice, cut)."""
    totals = landed(rows.groupBy("source").agg(
        F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_documents"), F.min("_weight").alias("lightest")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets(totals.drop("lightest"), most).withColumnRenamed("source", "name").withColumn("epochs", whole)
    plan = plan.join(totals.select("source", "lightest"), F.col("name").eqNullSafe(F.col("source"))).drop("source")
    plan = landed(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn(
        "slices", F.ceil(F.col("n_documents") / SLICE)))
    named = rows.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumn("slice", _slice())
    sums = named.groupBy("name", "slice").agg(F.sum("_size").alias("size"), F.first("rest").alias("rest"))
    before = F.sum("size").over(Window.partitionBy("name").orderBy("slice")) - F.col("size")
    ends = landed(sums.withColumn("before", before).where("before + size > rest").groupBy("name").agg(
        F.min(F.struct("slice", "before")).alias("at")).select(
        F.col("name").alias("end_name"), F.col("at.slice").alias("cut_slice"), F.col("at.before").alias("before")))
    last = named.join(ends, F.col("name").eqNullSafe(F.col("end_name")) & (F.col("slice") == F.col("cut_slice")))
    order = Window.partitionBy("name").orderBy("_sample", "key", "_size")
    # a document belongs to the prefix if the budget reaches its middle
    last = last.withColumn("middle", F.col("before") + F.sum("_size").over(
        order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size") / 2)
    cuts = last.where("middle <= rest").groupBy("name").agg(
        F.max(F.struct("_sample", "key", "_size")).alias("cut")).withColumnRenamed("name", "cut_name")
    plan = plan.join(ends.drop("before"), F.col("name").eqNullSafe(F.col("end_name")), "left").drop("end_name")
    return landed(plan.join(cuts, F.col("name").eqNullSafe(F.col("cut_name")), "left").drop("cut_name"))


def _copies() -> Column:
    chosen = (F.col("slice") < F.col("cut_slice")) | (
        (F.col("slice") == F.col("cut_slice")) & (F.struct("_sample", "key", "_size") <= F.col("cut")))
    return F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long")


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weight: Column | None = None, seed: str = "mix", most: int = 3) -> DataFrame:
    """One row per input row: key, size, source_size, target, copies, taken (size times copies).

    size: words in the text. Sources, ordered by code point with null last, weigh SHARES by turns and share the sum of
    all sizes; a target stops at `most` times its source's size, and the excess goes to the others by weight. Within a
    source all documents are taken in each complete epoch, then a weighted sample without replacement (`weight`, a
    positive column; by default `quality_weight`; null is 1) until the budget ends.

    A null text has size 0 and is taken as often as its place says. A row without key is drawn by its text. Rows that agree
    in key and size, or without key in the text, are taken or left together. Needs the shared folder.
    """
    rows = landed(_sized(documents, key, text, source, weight, seed).drop("document"))
    plan = mix_plan(rows, most)
    mixed = rows.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumn("slice", _slice()).withColumn("copies", _copies())
    return mixed.select(F.col("key").alias(key), F.col("_size").alias("size"), "source_size", "target", "copies",
                        (F.col("_size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    weight: Column | None = None, seed: str = "mix", most: int = 3) -> DataFrame:
    """The documents that `mix` takes, all columns, each as many times as it is taken.

    Whether a row is taken follows from the row and its source's plan, which has one row per source: texts are neither
    shuffled nor sorted while that table is small enough for Spark to broadcast.
    """
    own = _sized(documents, key, text, source, weight, seed)
    plan = mix_plan(landed(own.drop("document")), most)
    plan = plan.select("name", "epochs", "slices", "lightest", "cut_slice", "cut")
    columns = [F.col(f"document.{c}") for c in documents.columns]
    joined = own.join(plan, F.col("source").eqNullSafe(F.col("name")))
    copies = joined.withColumn("slice", _slice()).withColumn("copies", _copies()).where("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*columns)
