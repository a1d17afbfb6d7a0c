"""Outcomes of fetch attempts: counters, samples, failure classes and outages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filecensus.functions import rules
from filecensus.operators.scale import CHUNK_ROWS, ordinal_chunk, running_totals

# Consecutive failures that mean an outage, error samples a report shows.
BREAKER_LIMIT = 60
ERROR_SAMPLES = 10
OUTCOMES = {
    "downloaded": "success", "imported": "import", "skipped": "skip", "errors": "error",
    "restricted": "restricted", "repaired": "repair",
}


def failure_classes(attempts: DataFrame) -> DataFrame:
    kind = rules.failure_class(F.col("http_status"), F.col("reason"), F.col("errno"), F.col("exc_type"))
    return attempts.select("ordinal", "file_id", kind.alias("failure_class"))


def run_summary(attempts: DataFrame) -> DataFrame:
    """Counters of each account's run; only downloads and imports write bytes."""
    outcome = F.col("outcome")
    written = outcome.isin("success", "import")
    return attempts.groupBy("account").agg(
        *[F.count_if(outcome == value).alias(name) for name, value in OUTCOMES.items()],
        F.coalesce(F.sum(F.when(written, F.col("size"))), F.lit(0)).alias("bytes_written"),
    )


def error_samples(attempts: DataFrame, rows: int = ERROR_SAMPLES) -> DataFrame:
    """The first errors of a run, as its report shows them."""
    return attempts.filter("outcome = 'error'").orderBy("ordinal").limit(rows).select("ordinal", "file_id", "error")


def failure_runs(attempts: DataFrame, limit: int = BREAKER_LIMIT, chunk: Column | None = None) -> DataFrame:
    """Runs of at least `limit` consecutive errors per account.

    A success ends a run; a restricted file neither counts nor ends it. Runs are numbered by the
    successes before them, a running total that splits a busy account over many tasks.
    """
    cut = ordinal_chunk("ordinal", CHUNK_ROWS) if chunk is None else chunk
    success = F.when(F.col("outcome") == "success", 1).otherwise(0).cast("bigint")
    rows = attempts.filter(F.col("outcome").isin("success", "error")).select("account", "ordinal", "outcome")
    islands = running_totals(rows, ["account"], ["ordinal"], cut, {"island": success})
    return (
        islands.filter("outcome = 'error'")
        .groupBy("account", "island")
        .agg(F.count(F.lit(1)).alias("run_length"), F.min("ordinal").alias("first_ordinal"),
             F.max("ordinal").alias("last_ordinal"))
        .filter(F.col("run_length") >= limit)
        .drop("island")
    )
