"""Directories of ``*.log`` files as a batch or, for closed segments, as a stream."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podweave.functions.paths import uri_to_path

TEXT = {"recursiveFileLookup": "true", "pathGlobFilter": "*.log", "lineSep": "\n"}


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing(spark: SparkSession, per_core: int = 16) -> Iterator[None]:
    """Let Spark list directories with some tasks per core; by default it has one for each directory, up to 10,000."""
    most = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(most), per_core * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, most)


def read_logs(spark: SparkSession, *dirs: str) -> DataFrame:
    """``path, chunk, line_id, file_size, line`` of all files below the directories whose extension is ``log``.

    Lines end at a line feed only; a carriage return stays in the line. ``chunk`` is the byte at which the file split
    starts and ``line_id`` grows inside a split, so (path, chunk, line_id) is the order of the files without a shuffle,
    and one huge file is read by many tasks. A last line without line feed is included; see ``complete_lines``.
    """
    with listing(spark):
        lines = spark.read.options(**TEXT).text(list(dirs))
    return lines.select(
        uri_to_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("line"),
    )


def stream_segments(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None,
                    max_bytes_per_trigger: int | None = None) -> DataFrame:
    """``path, line`` of files that are written once and then left alone (rotated segments), new files per trigger.

    Spark takes one of the two limits. Segments of a few lines are better bounded by bytes: a trigger has costs of its own.
    A file that grows after it was seen is read by ``sources.tail``.
    """
    reader = spark.readStream.options(**TEXT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    path = uri_to_path(F.col("_metadata.file_path")).alias("path")
    return reader.text(directory).select(path, F.col("value").alias("line"))
