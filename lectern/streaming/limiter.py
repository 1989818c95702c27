"""The rate limiter as a stream: admissions of each key are state, evicted by the function itself.

Requests of one key within one micro-batch are put in order of time, so they are held together, as times and numbers; what a
micro-batch may take (`maxFilesPerTrigger`, `maxOffsetsPerTrigger`) bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.operators.limits import OUT, Log

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    def __init__(self, times: int, seconds: float):
        self.times, self.seconds = times, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("admissions", StructType([StructField("ts", DoubleType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        log = Log(self.times, self.seconds)
        log.held.extend(r[0] for r in self.state.get())
        batch = pd.concat([r[["key", "event_id", "ts"]] for r in rows]).sort_values(["ts", "event_id"])
        told = [log.ask(ts) for ts in batch["ts"]]
        self.state.put([(t,) for t in log.held])
        out = batch.copy()
        out["admitted"], out["retry_after"] = [t[0] for t in told], pd.array([t[1] for t in told], "float64")
        yield out

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, times: int, seconds: float) -> DataFrame:
    """A streaming DataFrame (key, event_id, ts) -> OUT. It needs the RocksDB state store, which stays set for the session, since it counts when the query starts."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return requests.groupBy("key").transformWithStateInPandas(Limiter(times, seconds), OUT, "append", "None")
