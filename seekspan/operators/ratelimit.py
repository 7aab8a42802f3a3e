"""Failure counting, alerts and the admission gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspan.functions import fixed

MICROS = 1_000_000


def failure_counts(attempts: DataFrame, window_seconds: int = fixed.FAILURE_WINDOW_SECONDS) -> DataFrame:
    """Failures of the same key in the window that ends at each attempt (strictly newer than its start).

    The count is a running sum of arrivals (+1) and expiries (-1), so a row costs the same however full its window is.
    Time is cut into cells of one window length and each attempt also reports to the next cell, where it expires: the
    sums are exact per (key, cell), and a key with a large share of all rows is spread over its cells.
    """
    width = window_seconds * MICROS
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    cell = F.floor(t / F.lit(width)).cast("bigint")

    def mark(at, where, delta, own):
        return F.struct(
            at.alias("at"), where.alias("cell"), F.lit(delta).alias("delta"), F.lit(own).alias("own")
        )

    marks = F.array(
        mark(t, cell, 1, True),
        mark(t, cell + 1, 1, False),
        mark(t + width, cell + 1, -1, False),
    )
    # expiries sort before arrivals of the same instant
    w = (
        Window.partitionBy("ip", "m.cell")
        .orderBy("m.at", "m.delta")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        attempts.withColumn("m", F.explode(marks))
        .withColumn("failures", F.sum("m.delta").over(w).cast("int"))
        .filter(F.col("m.own"))
        .drop("m")
    )


def first_alert(
    attempts: DataFrame,
    threshold: int = fixed.ALERT_THRESHOLD,
    window_seconds: int = fixed.FAILURE_WINDOW_SECONDS,
) -> DataFrame:
    """Per key the first time the window holds `threshold` failures."""
    return (
        failure_counts(attempts, window_seconds)
        .filter(F.col("failures") >= threshold)
        .groupBy("ip")
        .agg(F.min(F.struct("ts", "failures")).alias("a"))
        .select("ip", F.col("a.ts").alias("alert_at"), F.col("a.failures").alias("failures"))
    )


class GateState:
    """The last `limit` recorded failure times of one key."""

    __slots__ = ("limit", "width", "recent")

    def __init__(self, limit: int, width: int, recent: list[int] | None = None):
        self.limit, self.width, self.recent = limit, width, list(recent or [])

    def admit(self, times: np.ndarray, success: np.ndarray) -> np.ndarray:
        """Admission of time-ordered attempts; stretches of blocked attempts are skipped by binary search."""
        out = np.zeros(len(times), dtype=bool)
        i = 0
        while i < len(times):
            if len(self.recent) == self.limit:
                i = max(i, int(np.searchsorted(times, self.recent[0] + self.width, side="left")))
                if i >= len(times):
                    break
            out[i] = True
            if success[i]:
                self.recent = []
            else:
                self.recent = (self.recent + [int(times[i])])[-self.limit :]
            i += 1
        return out


def rate_gate(
    attempts: DataFrame,
    limit: int = fixed.FAILURE_LIMIT,
    window_seconds: int = fixed.FAILURE_WINDOW_SECONDS,
    order: str = "event_id",
) -> DataFrame:
    """Is each attempt admitted? Blocked when `limit` recorded failures are in the window; blocked attempts are
    not recorded; an admitted 'success' (optional column `kind`) clears the key.

    The outcome depends on the order of attempts, but never reaches across a pause of one window length. Attempts are
    therefore distributed by (key, session between such pauses), sorted by Spark, and read once as a stream of Arrow
    batches with the last `limit` times as the only state; no group is ever held in memory.
    """
    width = window_seconds * MICROS
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    success = F.col("kind") == "success" if "kind" in attempts.columns else F.lit(False)
    rows = attempts.select(
        "*", t.alias("__t"), F.floor(t / F.lit(width)).alias("__cell"), success.alias("__success")
    )
    by_key = Window.partitionBy("ip").orderBy("__cell")
    # sessions are found on one row per key and cell; within a cell no pause can be long enough
    spans = (
        rows.groupBy("ip", "__cell")
        .agg(F.min("__t").alias("lo"), F.max("__t").alias("hi"))
        .withColumn("fresh", (F.col("lo") - F.lag("hi").over(by_key) >= width).cast("int"))
        .withColumn("__session", F.coalesce(F.sum("fresh").over(by_key), F.lit(0)))
        .select("ip", "__cell", "__session")
    )
    ordered = (
        rows.join(spans, ["ip", "__cell"])
        .select("ip", "__session", "__t", "__success", *[c for c in attempts.columns if c != "ip"])
        .repartition("ip", "__session")
        .sortWithinPartitions("ip", "__session", "__t", order)
    )
    schema = T.StructType([*attempts.schema.fields, T.StructField("admitted", T.BooleanType())])
    names = attempts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = GateState(limit, width), None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.select(["ip", "__session"]).to_pandas()
            moments = batch.column("__t").to_numpy()
            wins = batch.column("__success").to_numpy(zero_copy_only=False)
            change = (keys != keys.shift()).any(axis=1).to_numpy()
            starts = np.union1d([0], np.nonzero(change)[0])
            admitted = np.zeros(n, dtype=bool)
            for a, b in zip(starts, [*starts[1:], n]):
                key = tuple(keys.iloc[a])
                if key != current:
                    state, current = GateState(limit, width), key
                admitted[a:b] = state.admit(moments[a:b], wins[a:b])
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(admitted)], names=[*names, "admitted"])

    return ordered.mapInArrow(run, schema)
