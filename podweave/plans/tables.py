"""Log data derived by Spark from the given tables: lines as CRI and Docker write them."""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podweave.operators.chunks import add_chunk, shared_folder

# Chunks small enough that the given tables' streams have several.
SPAN = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event: a tenth JSON, a tenth malformed, a tenth with an offset, a tenth partial."""
    return add_chunk(table(spark, sf_dir, "events").selectExpr("event_id", f"{EVENT_PATH} AS path",
                                                              "event_id * 2 AS arrival_ms", f"{EVENT_LINE} AS line"),
                     "event_id", 4 * SPAN)


STAMP = """date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")"""
EVENT_PATH = """'/var/log/pods/ns' || cast(user_id % 5 AS string) || '_pod_' || cast(user_id AS string) || '_u'
 || cast(user_id AS string) || '/web/0.log'"""
STREAM_NAME = "(CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END)"
EVENT_LINE = f"""CASE
 WHEN event_id % 10 = 0 THEN '{{"log":"' || event_type || ' ' || replace(props, '"', '\\\\"') || '\\\\n","stream":"'
  || {STREAM_NAME} || '","time":"' || {STAMP} || '789Z"}}'
 WHEN event_id % 10 = 8 THEN {STAMP} || 'Z stdlog F ' || event_type
 WHEN event_id % 10 = 7 THEN {STAMP} || '+05:30 stdout F ' || event_type || ' ' || props
 ELSE {STAMP} || '123Z ' || {STREAM_NAME} || (CASE WHEN event_id % 10 = 9 THEN ' P ' ELSE ' F ' END) || event_type
  || ' ' || props || (CASE WHEN event_id % 10 = 6 THEN chr(13) ELSE '' END) END"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one line, whole: JSON with its escapes for even ids, CRI for odd ones."""
    text = "replace(text, chr(10), ' ')"
    escaped = rf"""replace(replace({text}, '\\', '\\\\'), '"', '\\"')"""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "'/var/log/pods/docs_' || source || '_' || lang || '/text/' || cast(doc_id AS string) || '.log' AS path",
        rf"""CASE WHEN doc_id % 2 = 0 THEN '{{"log":"' || {escaped} ||
 '\\n","stream":"stdout","time":"2026-06-27T20:13:09.5Z"}}'
 ELSE '2026-06-27T20:13:09-07:00 stderr F ' || {text} END AS line""",
    )


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's HTML as one JSON line, whole, line ends and quotes escaped."""
    escaped = r"""replace(replace(replace(replace(html, '\\', '\\\\'), '"', '\\"'), chr(13), '\\r'), chr(10), '\\n')"""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        f"""'{{"time":"2026-01-01T00:00:00Z","log":"' || {escaped} || '","stream":"stderr"}}' AS line""",
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place the cluster names for checkpoints."""
    return f"{shared_folder(spark)}/podweave-{name}-{uuid.uuid4().hex}"


def by_path(lines: DataFrame) -> DataFrame:
    """A path's lines in one partition, of the same number in every table so dealt (AQE merges none)."""
    return lines.repartition(max(4, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")


def write_log_files(lines: DataFrame, directory: str, order: str, append: bool = False) -> None:
    """Write ``path, line`` as files below a mounted directory, as a container runtime leaves them.

    A pod's lines go to one file per partition and pod, so the tasks write side by side.
    """

    def write(rows):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path, sink = None, None
        for row in rows:
            if row.path != path:
                if sink is not None:
                    sink.close()
                path = row.path
                folder = f"{directory}/{path.lstrip('/')}".rsplit("/", 1)[0]
                os.makedirs(folder, exist_ok=True)
                sink = open(f"{folder}/{part}.log", "ab" if append else "wb")
            sink.write(row.line.encode() + b"\n")
        if sink is not None:
            sink.close()

    lines.select("path", order, "line").sortWithinPartitions("path", order).foreachPartition(write)


def rename_log_files(directory: str, suffix: str | None) -> None:
    """Add a suffix to all log files' names, as rotation does; without one, remove the files that have no such name."""
    for folder, _, names in os.walk(directory):
        for name in names:
            if suffix and name.endswith(".log"):
                os.rename(f"{folder}/{name}", f"{folder}/{name}{suffix}")
            elif not suffix and not name.endswith(".log"):
                os.remove(f"{folder}/{name}")
