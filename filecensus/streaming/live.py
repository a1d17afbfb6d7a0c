"""Live progress streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from filecensus.operators.progress import RUNNING_SECONDS, describe, latest_heartbeat, throughput_windows
from filecensus.operators.scale import newest

ACTIVITY = "account string, state string, ts timestamp"


def live_status(heartbeats: DataFrame) -> DataFrame:
    """Newest state per account; run in update or complete mode. State is one row per account."""
    beats = heartbeats.groupBy("account").agg(latest_heartbeat().alias("_beat"))
    return describe(beats.select("account", "_beat.*", F.lit("heartbeat").alias("source")))


def write_status(status: DataFrame, folder: str, checkpoint: str):
    """Write the accounts that changed in a micro-batch to its own folder (update mode).

    A batch that runs again replaces itself.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return status.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)


def read_status(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every account as of the last batch that changed it."""
    rows = spark.read.parquet(folder)
    return newest(rows, ["account"], "batch").drop("batch")


def live_throughput(transfers: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Bytes per account and window, emitted once a window is older than `delay` (append mode)."""
    return throughput_windows(transfers.withWatermark("ts", delay), width)


def write_heartbeats(heartbeats: DataFrame, folder: str, checkpoint: str):
    """Append heartbeats to a table partitioned by day."""
    return (
        heartbeats.withColumn("day", F.to_date("ts"))
        .writeStream.format("parquet").outputMode("append")
        .partitionBy("day")
        .option("path", folder).option("checkpointLocation", checkpoint)
    )


class _Activity(StatefulProcessor):
    """Says `live` when an account starts sending and `idle` once it has been silent for longer than so many seconds.

    Both carry event times: of the first heartbeat of a spell, and of its last one. Silences within a micro-batch
    are read off its heartbeats, others come from timers.
    """

    def __init__(self, seconds: int):
        self._silence = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", StructType([StructField("micros", LongType())]))

    def _due(self, micros: int) -> int:
        """When a spell has ended for sure, in the milliseconds that timers count."""
        return (micros + self._silence) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Times only, eight bytes a heartbeat.
        times = np.sort(np.concatenate([batch["micros"].to_numpy() for batch in rows]))
        known = self._last.get()[0] if self._last.exists() else None
        if known is not None:
            self._handle.deleteTimer(self._due(known))
            times = np.concatenate([[known], np.maximum(times, known)])
        breaks = np.flatnonzero(np.diff(times) > self._silence)
        found = [] if known is not None else [("live", times[0])]
        for i in breaks.tolist():
            found += [("idle", times[i]), ("live", times[i + 1])]
        self._last.update((int(times[-1]),))
        self._handle.registerTimer(self._due(int(times[-1])))
        if found:
            yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self._last.get()[0]
        self._last.clear()
        yield self._rows(key, [("idle", last)])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, found: list) -> pd.DataFrame:
        return pd.DataFrame({"account": [key[0]] * len(found), "state": [state for state, _ in found],
                             "micros": [int(micros) for _, micros in found]})


def activity(heartbeats: DataFrame, seconds: int = RUNNING_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """Changes between live and idle per account, on event time. Needs the RocksDB state store."""
    timed = heartbeats.withWatermark("ts", delay).select("account", "ts", F.unix_micros("ts").alias("micros"))
    changes = timed.groupBy("account").transformWithStateInPandas(
        statefulProcessor=_Activity(seconds), outputStructType="account string, state string, micros bigint",
        outputMode="append", timeMode="eventTime")
    return changes.select("account", "state", F.timestamp_micros("micros").alias("ts"))
