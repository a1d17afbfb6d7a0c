"""Incremental comparison of a listing with the current and the previous catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filecensus.functions import rules, text
from filecensus.operators.naming import unique_paths


def incremental_diff(listing: DataFrame, entries: DataFrame, previous: DataFrame) -> DataFrame:
    """Per listed file: done already, import from the previous snapshot, or fetch.

    A file is unchanged when the previous snapshot finished it with the same modification text and,
    unless it is a native export, the same size. All three tables meet on `file_id`.
    """
    done = entries.filter(rules.is_done(F.col("status"))).select("file_id", F.lit(True).alias("_done"))
    before = previous.select(
        "file_id", F.col("status").alias("_status"), F.col("modified_time").alias("_modified"),
        F.col("size").alias("_size"), F.col("rel_path").alias("previous_path"),
        F.col("sha256").alias("previous_sha256"))
    joined = listing.join(done, "file_id", "left").join(before, "file_id", "left")
    same_size = rules.is_native(F.col("mime_type")) | (F.col("_size") == F.col("size"))
    same = rules.is_done(F.col("_status")) & (F.col("_modified") == F.col("modified_time")) & same_size
    unchanged = F.coalesce(same, F.lit(False))
    outcome = F.when(F.col("_done"), "done").when(unchanged, "import").otherwise("fetch")
    imports = outcome == "import"
    return joined.select(
        *listing.columns, outcome.alias("outcome"),
        F.when(imports, F.col("previous_path")).alias("previous_path"),
        F.when(imports, F.col("_size")).alias("previous_size"),
        F.when(imports, F.col("previous_sha256")).alias("previous_sha256"))


def import_plan(diff: DataFrame, previous_tree: DataFrame) -> DataFrame:
    """Imports whose previous copy still has its size and hash; the others fall back to a fetch."""
    found = previous_tree.select(
        F.col("rel_path").alias("previous_path"), F.col("size").alias("_size"), F.col("sha256").alias("_sha256"),
        F.col("readable").alias("_readable"))
    joined = diff.filter("outcome = 'import'").join(found, "previous_path", "left")
    hashed = F.col("previous_sha256") != ""
    reason = (
        F.when(F.col("_size").isNull(), "missing")
        .when(F.col("_size") != F.col("previous_size"), "size_mismatch")
        .when(~F.col("_readable"), "unreadable")
        .when(hashed & ~F.col("_sha256").eqNullSafe(F.col("previous_sha256")), "hash_mismatch")
    )
    return joined.select(
        "ordinal", "file_id", "previous_path",
        F.when(reason.isNull(), "import").otherwise("fetch").alias("outcome"), reason.alias("fallback"))


def assign_paths(diff: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct local paths for files not done yet; paths of done files are never given away."""
    taken = entries.filter(rules.is_done(F.col("status"))).select("rel_path")
    rows = diff.filter("outcome <> 'done'").withColumn("_id_tag", text.id_tag(F.col("file_id")))
    return unique_paths(rows, "rel_path", "_id_tag", taken, "local_path").drop("_id_tag")
