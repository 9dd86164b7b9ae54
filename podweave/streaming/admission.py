"""Token-bucket admission on a stream, the bucket kept as Spark state per key."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from podweave.operators.admission import ceiled, spend
from podweave.settings import BURST, RATE_PER_SECOND

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bucket(StatefulProcessor):
    def __init__(self, order: str, clock_ms: str, cost: str, reset: str | None, rate: int, burst: int):
        self.order, self.clock_ms, self.cost, self.reset = order, clock_ms, cost, reset
        self.rate, self.burst = rate, ceiled(burst)

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("tokens", LongType()), StructField("last_ms", LongType())])
        self.state = handle.getValueState("bucket", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One key's rows of one trigger: bounded by the source's limit per trigger.
        frame = pd.concat(list(rows)).sort_values(self.order)
        resetting = frame[self.reset].fillna(False).astype(bool) if self.reset else False
        if frame[self.clock_ms].isna().any() or (frame[self.cost].isna() & ~resetting).any():
            raise ValueError("a request has no clock or no cost")
        old = self.state.get() if self.state.exists() else None
        resets = frame[self.reset].fillna(False).tolist() if self.reset else [False] * len(frame)
        verdicts, new = spend(
            old, frame[self.cost].tolist(), frame[self.clock_ms].tolist(), resets, self.rate, self.burst
        )
        self.state.update(tuple(int(v) for v in new))
        kept = frame.assign(admitted=verdicts)
        yield kept[kept["admitted"].notna()].astype({"admitted": bool})

    def close(self) -> None:
        pass


def admit_stream(
    requests: DataFrame, keys: list[str], order: str, clock_ms: str, cost: str,
    rate: int = RATE_PER_SECOND, burst: int = BURST, reset: str | None = None,
) -> DataFrame:
    """Streaming form of ``operators.admission.admit``: the requests with ``admitted``.

    Send slim rows through it (batches with their event count, not payloads). Late rows are taken as they come.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = StructType([*requests.schema.fields, StructField("admitted", BooleanType())])
    processor = Bucket(order, clock_ms, cost, reset, rate, burst)
    return requests.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")
