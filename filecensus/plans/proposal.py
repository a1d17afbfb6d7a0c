"""Proposal: what a tidy copy would keep, and how it splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filecensus.functions import measures, rules
from filecensus.functions.text import or_default
from filecensus.operators.duplicates import with_election
from filecensus.operators.scale import HOT_ROWS


def classify(entries: DataFrame, elect_among_clean: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Done entries with their junk reason, duplicate flag and verdict; junk wins over duplicate."""
    elected = with_election(entries, elect_among_clean, hot_rows)
    flagged = elected.withColumn("junk", rules.junk_reason(F.col("rel_path"), F.col("size")))
    verdict = F.when(F.col("junk").isNotNull(), "junk").when(F.col("is_duplicate"), "duplicate").otherwise("clean")
    return flagged.withColumn("verdict", verdict)


def _facts(classified: DataFrame) -> DataFrame:
    """Counts and bytes per verdict, category, source and year: the few rows all reports sum up."""
    path = F.col("rel_path")
    return classified.groupBy(
        "verdict",
        rules.category(path).alias("category"),
        or_default(F.col("drive_name"), "?").alias("source"),
        rules.year(F.col("modified_time"), "????").alias("year"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def _sum(value: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


def proposal_summary(classified: DataFrame) -> DataFrame:
    verdict = F.col("verdict")
    sums = classified.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    totals = sums.agg(
        _sum("n", F.lit(True)).alias("total_files"),
        _sum("bytes", F.lit(True)).alias("total_bytes"),
        _sum("n", verdict == "clean").alias("clean_files"),
        _sum("bytes", verdict == "clean").alias("clean_bytes"),
        _sum("n", verdict == "duplicate").alias("dupe_files"),
        _sum("bytes", verdict == "duplicate").alias("dupe_reclaim"),
        _sum("n", verdict == "junk").alias("junk_files"),
        _sum("bytes", verdict == "junk").alias("junk_bytes"),
    )
    return totals.select(
        "*",
        measures.round_even(measures.percent(F.col("clean_bytes"), F.col("total_bytes")), 4).alias("kept_pct"),
        measures.in_units(F.col("total_bytes"), measures.GIB, 2).alias("total_gb"),
        measures.in_units(F.col("clean_bytes"), measures.GIB, 2).alias("clean_gb"),
        measures.in_units(F.col("dupe_reclaim"), measures.GIB, 2).alias("dupe_reclaim_gb"),
        measures.in_units(F.col("junk_bytes"), measures.MIB, 1).alias("junk_mb"),
    )


def proposal_rollup(classified: DataFrame) -> DataFrame:
    """Clean files by category, by source and by year: (dimension, key, n, bytes)."""
    facts = _facts(classified.filter("verdict = 'clean'"))
    sets = facts.groupingSets([["category"], ["source"], ["year"]], "category", "source", "year").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.grouping_id().alias("_id"))
    dimension = F.when(F.col("_id") == 3, "category").when(F.col("_id") == 5, "source").otherwise("year")
    key = F.coalesce("category", "source", "year")
    return sets.select(dimension.alias("dimension"), key.alias("key"), "n", "bytes")


def rollup_by_year(rollup: DataFrame) -> DataFrame:
    """The years of a roll-up, oldest first."""
    return rollup.filter("dimension = 'year'").orderBy("key")


def rollup_bars(rollup: DataFrame) -> DataFrame:
    """Roll-up ordered for display, with each bar's width relative to its dimension's largest."""
    top = F.max("bytes").over(Window.partitionBy("dimension"))
    scale = F.when(top == 0, 1).otherwise(top)
    width = F.greatest(F.lit(1), F.floor(F.lit(100) * F.col("bytes") / scale).cast("bigint"))
    return rollup.withColumn("width", width).orderBy("dimension", F.desc("bytes"), "key")


def default_plan(classified: DataFrame, by_year: bool = True) -> DataFrame:
    """One editable row per file: action, source, destination and reason."""
    name = F.element_at(F.split("rel_path", "/"), -1)
    verdict = F.col("verdict")
    destination = (
        F.when(verdict == "junk", F.concat(F.lit("_quarantine/junk/"), name))
        .when(verdict == "duplicate", F.concat(F.lit("_quarantine/duplicates/"), name))
        .otherwise(rules.tidy_path(F.col("rel_path"), F.col("modified_time"), by_year))
    )
    code = F.when(verdict == "duplicate", "duplicate").otherwise(F.col("junk"))
    return classified.select(
        "ordinal",
        F.when(verdict == "clean", "keep").otherwise("quarantine").alias("action"),
        F.col("rel_path").alias("src_rel"),
        destination.alias("dest_rel"),
        rules.reason_label(code).alias("reason"),
    )
