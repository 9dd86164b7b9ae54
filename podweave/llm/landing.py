"""Intermediate tables in the folder that the cluster shares, and the package's own code on the executors."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch on its way to or from a Python worker.
ARROW_BYTES = 2 << 20

_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Only a local master, whose tasks all run on this machine, may do without it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="podweave-llm-"))


#: Bytes of input, as stored, for which a small table's last stage gets one task.
TASK_BYTES = 8 << 20


def landed(frame: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    Lineage ends there, so a lost executor costs no more than its own tasks, and Spark knows the table's true size when
    it chooses between a broadcast and a shuffle. `like` is a landed table that the rows are made of and that is at least
    as large: by its size in bytes the last stage is given fewer tasks where many would only write empty files.
    """
    spark = frame.sparkSession
    if like is not None:
        size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        frame = frame.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    path = f"{shared_folder(spark)}/podweave-llm/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes landed tables that no later step reads."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
            if "/podweave-llm/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_arrow(frame: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """`mapInArrow`, with the package sent to the executors first: they need no installed copy.

    From here on the session's Arrow batches hold ARROW_BYTES at most, so that long texts don't fill an executor.
    """
    spark, bound = frame.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+) *([a-z]?)[a-z]*", spark.conf.get(bound).lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit or "b") > ARROW_BYTES or int(number) <= 0:
        spark.conf.set(bound, str(ARROW_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='podweave-code-')}/podweave", "zip", root, "podweave")
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return frame.mapInArrow(function, schema)
