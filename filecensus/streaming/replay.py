"""The streaming operators run over a whole test table, as streams of several batches that end with it."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from filecensus.bridge import spark_view
from filecensus.operators.progress import RUNNING_SECONDS
from filecensus.operators.scale import run_folder
from filecensus.sources.heartbeats import read_heartbeats
from filecensus.streaming import breaker, live, upserts

# Files, and so micro-batches, that a table is streamed in: so many at least, and more to hold so many rows each.
FILES = 5
FILE_ROWS = 1_000_000


def _scratch(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, folder: str, view: str, scratch: str, order: str = "event_id",
            closing: str | None = None, batches: int | None = None) -> DataFrame:
    """A view over the events, which arrive file by file in the given order, or in about so many batches of files.

    With `closing`, one more event comes that much later, for windows to be closed by.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    number = F.unix_micros(F.col("ts").cast("timestamp")) if order == "ts" else F.col(order)
    files = max(FILES, -(-events.count() // FILE_ROWS))
    ends = events.select(F.percentile_approx(number, [i / files for i in range(1, files)], max(10_000, 100 * files))).first()[0]
    place = F.size(F.filter(F.array(*map(F.lit, ends or [])), lambda end: number > end))
    # The table is dealt into ranges in one pass.
    events.withColumn("_file", place).write.partitionBy("_file").parquet(f"{scratch}/ranges")
    ranges = spark.read.schema(f"{events._jdf.schema().toDDL()}, _file int").parquet(f"{scratch}/ranges")
    # One after the other, as a stream takes files in the order of their times; one file each, as each file is a batch.
    for i in range(files):
        rows = ranges.filter(F.col("_file") == i).drop("_file")
        rows.repartition(1).sortWithinPartitions(order).write.mode("append").parquet(f"{scratch}/events/file={i}")
    if closing is not None:
        late = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).withColumn("ts", F.col("ts") + F.expr(closing))
        late.coalesce(1).write.mode("append").parquet(f"{scratch}/events/file={files}")
    at_once = 1 if batches is None else -(-files // batches)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", at_once).option(
        "recursiveFileLookup", True).parquet(f"{scratch}/events")
    rows = spark_view(spark, folder, view, events=stream)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def run(writer) -> int:
    """Run a stream to the end of its source; returns the number of batches that had rows."""
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()
    return sum(progress["numInputRows"] > 0 for progress in started.recentProgress)


def live_status(spark: SparkSession, folder: str) -> DataFrame:
    scratch = _scratch(spark)
    status = live.live_status(_stream(spark, folder, "heartbeats", scratch))
    run(live.write_status(status, f"{scratch}/status", f"{scratch}/checkpoint"))
    return live.read_status(spark, f"{scratch}/status")


def heartbeat_table(spark: SparkSession, folder: str) -> DataFrame:
    """Heartbeats as the sink has written them."""
    scratch = _scratch(spark)
    beats = _stream(spark, folder, "heartbeats", scratch)
    run(live.write_heartbeats(beats, f"{scratch}/beats", f"{scratch}/checkpoint"))
    return read_heartbeats(spark, f"{scratch}/beats")


def live_throughput(spark: SparkSession, folder: str) -> DataFrame:
    scratch = _scratch(spark)
    attempts = _stream(spark, folder, "attempts", scratch, "ts", "INTERVAL 30 DAYS")
    run(live.live_throughput(attempts).writeStream.format("parquet").outputMode("append").option(
        "path", f"{scratch}/windows").option("checkpointLocation", f"{scratch}/checkpoint"))
    rows = spark.read.parquet(f"{scratch}/windows")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def breaker_alerts(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    scratch = _scratch(spark)
    run(breaker.watch(_stream(spark, folder, "attempts", scratch), scratch, f"{scratch}/checkpoint", limit))
    return breaker.read_alerts(spark, scratch)


def live_catalog(spark: SparkSession, folder: str) -> DataFrame:
    scratch = _scratch(spark)
    run(upserts.follow(_stream(spark, folder, "entry_log", scratch), f"{scratch}/catalog", f"{scratch}/checkpoint"))
    return upserts.current(spark, f"{scratch}/catalog")


def live_activity(spark: SparkSession, folder: str, seconds: int = RUNNING_SECONDS) -> DataFrame:
    """Changes between live and idle; the last event comes again 30 days later and closes all other accounts' spells.

    Each batch costs a call for each account in it, so batches grow with the table: their number times that of the
    accounts would grow with its square.
    """
    scratch = _scratch(spark)
    beats = _stream(spark, folder, "heartbeats", scratch, "ts", "INTERVAL 30 DAYS", FILES)
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass",
                  "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        run(live.activity(beats, seconds, "1 second").writeStream.format("parquet").outputMode("append").option(
            "path", f"{scratch}/changes").option("checkpointLocation", f"{scratch}/checkpoint"))
    rows = spark.read.schema(live.ACTIVITY).parquet(f"{scratch}/changes")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
