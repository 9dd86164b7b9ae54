"""Batches with the latest earlier registration of their stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podweave.operators.chunks import before


def latest_registration(
    batches: DataFrame, registrations: DataFrame, keys: list[str], chunk: str, order: str
) -> DataFrame:
    """Left as-of join: a batch without an earlier registration stays, with nulls.

    A registration at the batch's own order value counts as earlier. Inside a chunk a running ``last`` finds the registration; the one from earlier chunks is the chunk's seed row.
    Both tables need the keys, the chunk and the order column; the other columns of the registrations are added.
    """
    group = [*keys, chunk]
    added = [c for c in registrations.columns if c not in (*group, order)]
    known = registrations.select(*group, order, F.struct(*added).alias("_known"))
    per_chunk = known.groupBy(*group).agg(F.max_by("_known", order).alias("_known"))
    chunks = batches.select(*group).distinct().withColumn("_known", F.lit(None).cast(known.schema["_known"].dataType))
    per_chunk = per_chunk.unionByName(chunks).groupBy(*group).agg(F.first("_known", ignorenulls=True).alias("_known"))
    seeds = per_chunk.select(*group, F.last("_known", ignorenulls=True).over(before(keys, chunk)).alias("_known"))
    merged = (
        batches.withColumn("_kind", F.lit(2))
        .unionByName(known.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(seeds.where("_known IS NOT NULL").withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    )
    # Seeds first; of rows with one order value the registration comes before the batch.
    so_far = Window.partitionBy(*group).orderBy(F.least("_kind", F.lit(1)), order, "_kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    joined = merged.withColumn("_known", F.last("_known", ignorenulls=True).over(so_far)).where("_kind = 2")
    return joined.select(*batches.columns, *(F.col(f"_known.{c}").alias(c) for c in added))
