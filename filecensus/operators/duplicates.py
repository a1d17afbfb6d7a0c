"""Exact duplicates: one primary per content hash, the rest are its copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filecensus.functions import rules, text
from filecensus.operators.scale import HOT_ROWS, cut_lineage_counted, lookup


def _hashed(entries: DataFrame) -> DataFrame:
    return entries.filter(rules.is_done(F.col("status")) & (F.col("sha256") != ""))


def elections(entries: DataFrame, elect_among_clean: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per hash that occurs twice or more: copies, bytes and the elected primary.

    The primary has the fewest folders, then the shortest path, then the first path. Folders and
    length are one number, whose minimum is hashed together with the counts: map tasks send one row per
    hash, and a hot hash costs no more than others. Paths are only compared between copies that the
    number leaves tied.
    """
    path = F.col("rel_path")
    junk = rules.junk_reason(path, F.col("size")).isNotNull()
    place = F.shiftleft(text.depth(path).cast("bigint"), 40) + F.length(path)
    if elect_among_clean:
        # Clutter is only elected when there is nothing else.
        place += F.when(junk, 1 << 62).otherwise(0)
    rows = _hashed(entries).select("sha256", "ordinal", "rel_path", "size", place.alias("_place"), junk.alias("_junk"))
    counts, seen = cut_lineage_counted(rows.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_if(~F.col("_junk")).alias("n_clean"),
        F.min("_place").alias("_least")).filter("n > 1"), heaviest=F.max("n"))
    facts = counts.select("sha256", "n", "_least")
    tied = lookup(rows, facts, ["sha256"], "n", F.col("ordinal"), hot_rows, seen["heaviest"] or 0).filter("_place = _least")
    first = tied.groupBy("sha256").agg(F.min(F.struct("rel_path", "ordinal", "size")).alias("primary"))
    return counts.drop("_least").join(first, "sha256")


def exact_duplicates(entries: DataFrame, elect_among_clean: bool = False) -> DataFrame:
    """Duplicate groups: kind, key, primary, number of copies and the bytes they hold.

    The copies themselves are rows of `duplicate_members`, never one array per group.
    """
    return elections(entries, elect_among_clean).select(
        F.lit("exact").alias("kind"),
        F.col("sha256").alias("key"),
        F.col("primary.rel_path").alias("primary"),
        (F.col("n") - 1).alias("n_duplicates"),
        (F.col("bytes") - F.col("primary.size")).alias("reclaimable_bytes"),
    )


def with_election(entries: DataFrame, elect_among_clean: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Done entries with `primary` (null when the content is unique) and `is_duplicate`."""
    done = entries.filter(rules.is_done(F.col("status")))
    chosen, seen = cut_lineage_counted(elections(entries, elect_among_clean, hot_rows).select(
        "sha256", F.col("n").alias("_n"), F.col("primary.rel_path").alias("primary"),
        F.col("primary.ordinal").alias("_primary_ordinal")), heaviest=F.max("_n"))
    joined = lookup(done, chosen, ["sha256"], "_n", F.col("ordinal"), hot_rows, seen["heaviest"] or 0)
    copy = F.coalesce(F.col("_primary_ordinal") != F.col("ordinal"), F.lit(False))
    return joined.withColumn("is_duplicate", copy).drop("_n", "_primary_ordinal")


def duplicate_members(entries: DataFrame, elect_among_clean: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per redundant copy, with the primary it repeats."""
    elected = with_election(entries, elect_among_clean, hot_rows)
    return elected.filter("is_duplicate").select(
        F.lit("exact").alias("kind"), F.col("sha256").alias("key"), "primary", "ordinal",
        F.col("rel_path").alias("duplicate"), "size")


def dedup_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("n_duplicates"), F.lit(0)).alias("duplicate_files"),
        F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
    )


def orphaned_by_junk(entries: DataFrame) -> DataFrame:
    """Hashes whose primary is clutter though a clean copy exists: all copies would be quarantined."""
    primary, size = F.col("primary.rel_path"), F.col("primary.size")
    lost = rules.junk_reason(primary, size).isNotNull() & (F.col("n_clean") > 0)
    return elections(entries).filter(lost).select("sha256", primary.alias("primary"), "n_clean")


def all_groups(exact: DataFrame, near: DataFrame) -> DataFrame:
    """Exact and near groups in one table; `kind` tells them apart."""
    return exact.unionByName(near)
