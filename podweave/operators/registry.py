"""The stream registry: one row per path with its stream id and pod identity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podweave.functions.paths import pod_metadata
from podweave.operators.chunks import join_lookup, number_rows


def build_registry(events: DataFrame, order: str, path: str = "path", known: DataFrame | None = None) -> DataFrame:
    """``stream_id, path, first_seen, namespace, pod_name, pod_uid, container_name``; ids 1, 2, 3… by first event.

    With ``known``, an earlier registry, only the new paths are returned and their ids go on behind its highest.
    """
    firsts = events.groupBy(path).agg(F.min(order).alias("first_seen"))
    start = 1
    if known is not None:
        firsts = firsts.join(known.select(path), path, "left_anti")
        start = (known.agg(F.max("stream_id")).first()[0] or 0) + 1
    numbered = number_rows(firsts, "first_seen", path, name="stream_id", start=start)
    return numbered.select("stream_id", path, "first_seen", pod_metadata(F.col(path)).alias("_pod")).select(
        "stream_id", path, "first_seen", "_pod.*"
    )


def join_registry(events: DataFrame, registry: DataFrame, path: str = "path") -> DataFrame:
    """Events with their stream's id and pod identity."""
    return join_lookup(events, registry.drop("first_seen"), [path])
