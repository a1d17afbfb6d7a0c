"""Live progress from heartbeats: latest state, rates, history and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filecensus.functions import measures
from filecensus.operators.scale import newest, ranked, with_context

# A heartbeat younger than this means a running backup; points and floor of the graph.
RUNNING_SECONDS = 60
HISTORY = 80
SCALE_FLOOR = 0.1
BLOCK_ROWS = 8192

_STATE = ["done", "expected", "errors", "bytes_written", "expected_bytes", "bytes_inflight"]


def _day(ts: str = "ts") -> Column:
    """Chunk of a heartbeat: one account sends a bounded number of heartbeats a day."""
    return F.to_date(F.col(ts))


def latest_heartbeat() -> Column:
    """The state carried by an account's newest heartbeat, as an aggregate; of equal times, the largest state."""
    rate = measures.run_rate(F.col("rate_bps"), F.col("bytes_written"), F.col("elapsed_s"))
    state = F.struct("ts", "bytes_written", *[c for c in _STATE if c != "bytes_written"], rate.alias("rate_bps"))
    return F.max(state)


def describe(states: DataFrame) -> DataFrame:
    """Percentages, remaining bytes, ETA and the finished flag of progress states."""
    col = F.col
    effective = col("bytes_written") + col("bytes_inflight")
    remaining = measures.remaining_bytes(
        col("expected_bytes"), effective, col("bytes_written"), col("done"), col("expected"))
    by_bytes = measures.percent_bytes(effective, col("expected_bytes"), col("done"), col("expected"))
    return states.select(
        "account", *_STATE, measures.round_even(F.col("rate_bps"), 3).alias("rate_bps"), "source",
        effective.alias("effective_bytes"),
        measures.round_even(measures.percent(col("done"), col("expected")), 2).alias("pct"),
        measures.round_even(by_bytes, 2).alias("pct_bytes"),
        measures.round_even(remaining, 3).alias("remaining_bytes"),
        measures.eta_text(remaining, col("rate_bps")).alias("eta"),
        ((col("expected") > 0) & (col("done") + col("errors") >= col("expected"))).alias("finished"),
    )


def progress_snapshot(heartbeats: DataFrame, headers: DataFrame) -> DataFrame:
    """Progress per account: its newest heartbeat, else the header of its catalog.

    `headers` has account, count, done, expected_total, total_bytes and expected_bytes. A header
    counts everything not done as an error.
    """
    # Of each account only the rows of its newest time are put in order, one as a rule.
    beats = newest(heartbeats, ["account"], "ts").groupBy("account").agg(latest_heartbeat().alias("_beat"))
    joined = headers.withColumn("_header", F.struct(*[c for c in headers.columns if c != "account"])).select(
        "account", "_header").join(beats, "account", "full")
    head, beat = F.col("_header"), F.col("_beat")
    alive = beat.isNotNull()
    fallback = {
        "done": head["done"], "expected": head["expected_total"],
        "errors": F.greatest(F.lit(0), head["count"] - head["done"]), "bytes_written": head["total_bytes"],
        "expected_bytes": head["expected_bytes"], "bytes_inflight": F.lit(0).cast("bigint"),
    }
    return describe(joined.select(
        "account",
        *[F.when(alive, beat[n]).otherwise(fallback[n]).alias(n) for n in _STATE],
        F.when(alive, beat["rate_bps"]).otherwise(0.0).alias("rate_bps"),
        F.when(alive, "heartbeat").otherwise("manifest").alias("source"),
    ))


def _seconds_between(before: Column, after: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", before, after) / F.lit(1e6)


def _polls(heartbeats: DataFrame, look_back: int, block_rows: int, chunk: Column | None) -> DataFrame:
    rows = heartbeats.select("account", "ts", "bytes_written")
    placed = ranked(rows, ["account"], ["ts", "bytes_written"], _day() if chunk is None else chunk, "place")
    return with_context(placed, "place", look_back, block_rows)


def _with_rate(polls: DataFrame) -> DataFrame:
    """Bytes per second since the previous poll; null at the first poll and without elapsed time."""
    order = Window.partitionBy("account", "block").orderBy("ts", "bytes_written")
    passed = _seconds_between(F.lag("ts").over(order), F.col("ts"))
    moved = F.col("bytes_written") - F.lag("bytes_written").over(order)
    return polls.withColumn("rate_bps", F.when(passed > 0, moved / passed))


def progress_rate(heartbeats: DataFrame, block_rows: int = BLOCK_ROWS, chunk: Column | None = None) -> DataFrame:
    """Rate between consecutive heartbeats of an account."""
    rates = _with_rate(_polls(heartbeats, 1, block_rows, chunk)).filter("NOT context")
    return rates.select("account", "ts", measures.round_even(F.col("rate_bps"), 3).alias("rate_bps"))


def rate_history(heartbeats: DataFrame, points: int = HISTORY, block_rows: int = BLOCK_ROWS,
                 chunk: Column | None = None) -> DataFrame:
    """Rates in MB/s with the scale of the graph at that moment: the largest of the last points."""
    rates = _with_rate(_polls(heartbeats, points, block_rows, chunk))
    speed = F.coalesce(F.col("rate_bps"), F.lit(0.0)) / F.lit(1e6)
    recent = Window.partitionBy("account", "block").orderBy("ts", "bytes_written").rowsBetween(1 - points, 0)
    scaled = rates.withColumn("mb_s", speed).withColumn(
        "scale", F.greatest(F.max("mb_s").over(recent), F.lit(SCALE_FLOOR)))
    return scaled.filter("NOT context").select(
        "account", "ts", measures.round_even(F.col("mb_s"), 6).alias("mb_s"), measures.round_even(F.col("scale"), 6).alias("scale"))


def running_state(heartbeats: DataFrame, as_of: Column, seconds: int = RUNNING_SECONDS) -> DataFrame:
    """Live or idle per account at a given moment."""
    last = heartbeats.groupBy("account").agg(F.max("ts").alias("last_ts"))
    fresh = _seconds_between(F.col("last_ts"), as_of) < seconds
    return last.select("account", "last_ts", F.when(fresh, "live").otherwise("idle").alias("state"))


def throughput_windows(transfers: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Bytes and files per account and time window; the same expression serves streams."""
    return transfers.groupBy("account", F.window("ts", width).alias("_w")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files")
    ).select("account", F.col("_w.start").alias("window_start"), "bytes", "files")
