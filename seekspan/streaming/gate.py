"""G6 as a stateful stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seekspan.functions import fixed
from seekspan.operators.ratelimit import MICROS, GateState

OUTPUT = "ip string, event_id bigint, ts timestamp, admitted boolean"


class GateProcessor(StatefulProcessor):
    """State per key: the last `limit` recorded failure times, dropped when the key has been idle for `idle_seconds`."""

    def __init__(self, limit: int, window_seconds: int, idle_seconds: int):
        self.limit, self.width, self.idle = limit, window_seconds * MICROS, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        recent = T.StructType([T.StructField("recent", T.ArrayType(T.LongType()))])
        # wall-clock expiry only bounds the state; correctness comes from the times themselves
        self.state = handle.getValueState("recent", recent, self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # one key's rows of one micro-batch, which the rate limit of the source bounds; they have to be put in order
        batch = pd.concat(list(rows)).sort_values(["micros", "event_id"], kind="stable")
        known = list(self.state.get()[0]) if self.state.exists() else []
        gate = GateState(self.limit, self.width, known)
        admitted = gate.admit(batch["micros"].to_numpy(), batch["success"].to_numpy(dtype=bool))
        self.state.update((gate.recent,))
        yield pd.DataFrame(
            {
                "ip": str(key[0]),
                "event_id": batch["event_id"].to_numpy(),
                "ts": pd.to_datetime(batch["micros"].to_numpy(), unit="us"),
                "admitted": np.asarray(admitted),
            }
        )

    def close(self) -> None:
        pass


def stream_gate(
    attempts: DataFrame,
    limit: int = fixed.FAILURE_LIMIT,
    window_seconds: int = fixed.FAILURE_WINDOW_SECONDS,
    idle_seconds: int | None = None,
) -> DataFrame:
    """Admission of attempts `(ip, event_id, ts[, kind])` as they arrive. Needs the RocksDB state store.

    The state of a key expires `idle_seconds` of wall-clock time after its last attempt, by default ten windows: a stream
    that was paused for longer than that starts counting anew. A run that shall end when it has read what is there
    (`availableNow`) needs `spark.sql.streaming.noDataMicroBatches.enabled=false`, since expiry by the clock otherwise asks
    for one more batch again and again."""
    idle_seconds = 10 * window_seconds if idle_seconds is None else idle_seconds
    success = F.col("kind") == "success" if "kind" in attempts.columns else F.lit(False)
    rows = attempts.select(
        F.col("ip").cast("string").alias("ip"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        success.alias("success"),
    )
    # Spark starts the processor once on the driver, in a worker that does not see shipped packages: send it by value
    package = sys.modules[__name__.split(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        return rows.groupBy("ip").transformWithStateInPandas(
            statefulProcessor=GateProcessor(limit, window_seconds, idle_seconds),
            outputStructType=T.StructType.fromDDL(OUTPUT),
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    finally:
        cloudpickle.unregister_pickle_by_value(package)
