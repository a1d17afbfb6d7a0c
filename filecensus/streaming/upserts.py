"""Continuous catalog upserts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from filecensus.operators.scale import newest
from filecensus.streaming import store


def merge(log: DataFrame, key: str = "file_id") -> DataFrame:
    """Last value per key with its first and last place; merging merged logs gives the same.

    No two rows of the log share an ordinal.
    """
    rows = log if "last_ordinal" in log.columns else log.withColumn("last_ordinal", F.col("ordinal"))
    last = newest(rows, [key], "last_ordinal", _first=F.min("ordinal"))
    return last.withColumn("ordinal", F.col("_first")).select(*rows.columns)


def follow(log: DataFrame, folder: str, checkpoint: str, key: str = "file_id"):
    """Merge each micro-batch into the catalog at `folder`; a batch that runs again changes nothing."""
    def step(batch: DataFrame, batch_id: int) -> None:
        store.commit(folder, batch_id, batch, functools.partial(merge, key=key))

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, folder: str, key: str = "file_id") -> DataFrame:
    """The catalog as of the last batch."""
    return merge(store.read(spark, folder), key).drop("last_ordinal")
