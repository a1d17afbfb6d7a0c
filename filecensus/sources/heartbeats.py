"""Heartbeat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filecensus.schemas import HEARTBEAT


def read_heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{HEARTBEAT}, day date").parquet(folder).drop("day")


def stream_heartbeats(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON heartbeats as they arrive, one object per line."""
    return (spark.readStream.schema(HEARTBEAT).option("maxFilesPerTrigger", files_per_batch).json(folder))
