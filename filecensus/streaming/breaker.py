"""Outage alerts on a stream of fetch attempts.

A stretch of an account's attempts comes down to a summary: the errors before its first success, those after its
last one, and the alerts between. Summaries of neighbouring stretches merge, so a batch is cut into chunks of
bounded rows, however busy an account is, and only one small row of each chunk meets the run that the account's
earlier batches left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from filecensus.operators.failures import BREAKER_LIMIT
from filecensus.operators.scale import cut_lineage, newest, ordinal_chunk
from filecensus.streaming import store

ALERT = "account string, first_ordinal bigint"
_OPEN = "account string, first bigint, length bigint, batch bigint"


def summaries(attempts: DataFrame, limit: int = BREAKER_LIMIT, chunk: Column | None = None) -> DataFrame:
    """account, chunk, whole (no success), lead and tail (first ordinal and number of errors), inner alerts.

    A success ends a run; a restricted file neither counts nor ends it.
    """
    cut = ordinal_chunk("ordinal") if chunk is None else chunk
    rows = attempts.filter(F.col("outcome").isin("success", "error")).select(
        "account", "ordinal", (F.col("outcome") == "error").alias("failed"), cut.alias("chunk"))
    inside = Window.partitionBy("account", "chunk")
    so_far = inside.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.withColumn("island", F.count_if(~F.col("failed")).over(so_far)).groupBy("account", "chunk", "island").agg(
        F.count_if("failed").alias("length"), F.min(F.when(F.col("failed"), F.col("ordinal"))).alias("first"))
    runs = runs.withColumn("last", F.max("island").over(inside))

    def of(where: Column) -> list[Column]:
        return [F.max(F.when(where, F.col("first"))), F.coalesce(F.max(F.when(where, F.col("length"))), F.lit(0))]

    (lead, lead_length), (tail, tail_length) = of(F.col("island") == 0), of(F.col("island") == F.col("last"))
    between = (F.col("island") > 0) & (F.col("island") < F.col("last")) & (F.col("length") >= limit)
    return runs.groupBy("account", "chunk").agg(
        (F.max("last") == 0).alias("whole"), lead.alias("lead"), lead_length.alias("lead_length"), tail.alias("tail"),
        tail_length.alias("tail_length"), F.collect_list(F.when(between, F.col("first"))).alias("inner"))


def fold(found: DataFrame, carried: DataFrame, limit: int) -> DataFrame:
    """account, first and length of the run left open, and the alerts, of the accounts that have summaries."""
    part = ["chunk", "whole", "lead", "lead_length", "tail", "tail_length", "inner"]
    # What is left open from before is a stretch whose alert has been given.
    before = carried.select(
        "account", F.lit(None).cast("bigint").alias("chunk"), F.lit(False).alias("whole"), F.lit(None).cast("bigint").alias("lead"),
        F.lit(0).cast("bigint").alias("lead_length"), F.col("first").alias("tail"), F.col("length").alias("tail_length"),
        F.array().cast("array<bigint>").alias("inner"))
    grouped = found.union(before.select(*found.columns)).groupBy("account").agg(
        F.sort_array(F.collect_list(F.struct(*part))).alias("parts"), F.count("chunk").alias("n")).filter("n > 0")
    none = F.array().cast("array<bigint>")

    def step(state: Column, x: Column) -> Column:
        length = state["length"] + x["lead_length"]
        first = F.when(state["length"] == 0, x["lead"]).otherwise(state["first"])
        reached = (state["length"] < limit) & (length >= limit)
        fresh = ~x["whole"] & x["chunk"].isNotNull() & (x["tail_length"] >= limit)
        alerts = F.concat(state["alerts"], F.when(reached, F.array(first)).otherwise(none), x["inner"],
                          F.when(fresh, F.array(x["tail"])).otherwise(none))
        return F.struct(F.when(x["whole"], first).otherwise(x["tail"]).alias("first"),
                        F.when(x["whole"], length).otherwise(x["tail_length"]).alias("length"), alerts.alias("alerts"))

    start = F.struct(F.lit(None).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("length"), none.alias("alerts"))
    return grouped.select("account", F.aggregate("parts", start, step).alias("state")).select("account", "state.*")


def _latest(runs: DataFrame) -> DataFrame:
    return newest(runs, ["account"], "batch")


def watch(attempts: DataFrame, folder: str, checkpoint: str, limit: int = BREAKER_LIMIT, chunk: Column | None = None):
    """Write one row (account, first_ordinal) to `folder`/alerts when a run of errors reaches `limit`.

    Attempts of an account come in `ordinal` order from batch to batch, and in any order within one. Open runs are
    kept in `folder`/open. A batch that runs again replaces its alerts, or finds them given.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.last_batch(spark, f"{folder}/open") >= batch_id:
            return
        known = store.read(spark, f"{folder}/open")
        carried = spark.createDataFrame([], _OPEN) if known is None else _latest(known)
        told = cut_lineage(fold(summaries(batch, limit, chunk), carried.filter("length > 0"), limit))
        told.select("account", F.explode("alerts").alias("first_ordinal")).write.mode("overwrite").parquet(
            f"{folder}/alerts/batch={batch_id}")
        left = told.select("account", "first", "length", F.lit(batch_id).cast("bigint").alias("batch"))
        store.commit(f"{folder}/open", batch_id, left, _latest)

    return attempts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ALERT).parquet(f"{folder}/alerts").select("account", "first_ordinal")
