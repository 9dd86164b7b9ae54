"""Byte offsets of lines read from files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from podweave.operators.chunks import before


def with_offsets(lines: DataFrame, keys: list[str] = ["path"], chunk: str = "chunk", order: str = "line_id",
                 line: str = "line") -> DataFrame:
    """Add ``offset``, the byte position at which a line starts in its file.

    A line takes its bytes and one line feed. The sums of whole chunks come from a grouping, the running sum stays
    inside a chunk, so no task sees more of a file than one split.
    """
    taken = (F.octet_length(line) + 1).cast("bigint")
    sums = lines.groupBy(*keys, chunk).agg(F.sum(taken).alias("_bytes"))
    bases = sums.select(*keys, chunk, F.coalesce(F.sum("_bytes").over(before(keys, chunk)), F.lit(0)).alias("_base"))
    earlier = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # One row of bases per chunk; it takes the window's place in the shuffle instead of a join.
    merged = lines.withColumn("_line", F.lit(1)).unionByName(
        bases.withColumns({"_line": F.lit(0), order: F.lit(-1).cast("bigint")}), allowMissingColumns=True
    )
    step = F.when(F.col("_line") == 1, taken).otherwise(F.col("_base"))
    placed = merged.withColumn("offset", F.sum(step).over(earlier))
    return placed.where("_line = 1").drop("_line", "_base")


def complete_lines(lines: DataFrame, file_size: str = "file_size", line: str = "line") -> DataFrame:
    """Hold back a last line without its line feed; takes lines with ``offset``."""
    return lines.where(F.col("offset") + F.octet_length(line) < F.col(file_size))
