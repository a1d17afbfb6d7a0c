"""Catalog upkeep and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filecensus.functions import rules
from filecensus.functions.text import or_default
from filecensus.operators.scale import newest
from filecensus.schemas import ENTRY_COLUMNS

# Fixed value: bytes reserved for each native document not yet exported.
NATIVE_RESERVE = 10 * 1024 * 1024


def coerce_entries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog rows with nulls and text sizes settled, and the rows whose size is no whole number."""
    texts = [c for c in ENTRY_COLUMNS if c not in ("ordinal", "size", "status")]
    others = [c for c in rows.columns if c not in ENTRY_COLUMNS]
    size_text = F.trim(F.col("size").cast("string"))
    size = F.when(size_text.rlike(r"^[+-]?[0-9]+$"), size_text.try_cast("bigint"))
    empty = F.coalesce(size_text, F.lit("")) == ""
    settled = rows.withColumn("_size", F.when(empty, F.lit(0)).otherwise(size))
    bad = settled.filter(F.col("_size").isNull()).drop("_size")
    good = settled.filter(F.col("_size").isNotNull()).select(
        "ordinal",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts],
        F.col("_size").cast("bigint").alias("size"),
        or_default(F.col("status"), "pending").alias("status"),
        *others,
    )
    return good.select(*ENTRY_COLUMNS, *others), bad


def upsert(log: DataFrame, key: str = "file_id") -> DataFrame:
    """Last value of every key, at the place where the key first appeared.

    No two rows of the log share an ordinal.
    """
    values = [c for c in log.columns if c not in (key, "ordinal")]
    last = newest(log, [key], "ordinal", _first=F.min("ordinal"))
    return last.select(F.col("_first").alias("ordinal"), key, *values)


def prune_stale(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Drop rows that never finished and whose id is no longer listed; finished rows stay."""
    listed = listing.select("file_id").distinct().withColumn("_listed", F.lit(True))
    keep = rules.is_done(F.col("status")) | F.col("_listed").isNotNull() | (F.col("file_id") == "")
    return entries.join(listed, "file_id", "left").filter(keep).select(*entries.columns)


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _bytes(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("size"))), F.lit(0)).cast("bigint")


def status_counts(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, done rows, their bytes, failed and restricted rows: the header of a snapshot."""
    status = F.col("status")
    return entries.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("count"),
        _count(rules.is_done(status)).alias("done"),
        _bytes(rules.is_done(status)).alias("total_bytes"),
        _count(rules.is_failed(status)).alias("failed"),
        _count(rules.is_restricted(status)).alias("restricted"),
    )


def completeness_columns(failed: Column, restricted: Column, done: Column, expected: Column) -> dict[str, Column]:
    """Whether a snapshot holds all that was listed, and why."""
    accounted = done + restricted
    known = F.coalesce(expected, F.lit(0))
    reason = (
        F.when(failed > 0, "failed")
        .when((known != 0) & (accounted < known), "missing")
        .when(restricted > 0, "restricted")
        .when(known == 0, "unproven")
        .otherwise("complete")
    )
    return {
        "complete": ~reason.isin("failed", "missing"),
        "reason": reason,
        "accounted": accounted,
        "expected": known,
    }


def completeness(entries: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """One row per snapshot: complete, reason code and the counts behind it.

    `snapshots` carries the keys and `expected_total`; a snapshot without entries counts as empty.
    """
    counts = status_counts(entries, keys)
    joined = snapshots.select(*keys, "expected_total").join(counts, keys, "left")
    done, failed, restricted = (F.coalesce(F.col(c), F.lit(0)) for c in ("done", "failed", "restricted"))
    columns = completeness_columns(failed, restricted, done, F.col("expected_total"))
    return joined.select(
        *keys,
        *[value.alias(name) for name, value in columns.items()],
        failed.alias("n_failed"),
        restricted.alias("n_restricted"),
    )


def listed_missing(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files no entry accounts for: vanished done rows cannot hide them here."""
    settled = entries.filter(~rules.is_failed(F.col("status"))).select("file_id")
    return listing.join(settled, "file_id", "left_anti")


def listing_totals(listing: DataFrame, entries: DataFrame) -> DataFrame:
    """Files and bytes listed, and what is left to fetch with its reserve for native exports."""
    done = entries.filter(rules.is_done(F.col("status"))).select("file_id", F.lit(True).alias("_done")).distinct()
    rows = listing.join(done, "file_id", "left")
    pending = F.col("_done").isNull()
    native = rules.is_native(F.col("mime_type"))
    return rows.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("known_bytes"),
        _count(native).alias("native_files"),
        _count(native & pending).alias("native_pending"),
        _bytes(pending).alias("remaining_known"),
    ).select(
        "*",
        (F.col("native_pending") * NATIVE_RESERVE).alias("native_reserve"),
        (F.col("remaining_known") + F.col("native_pending") * NATIVE_RESERVE).alias("required_bytes"),
    )


def by_category(entries: DataFrame) -> DataFrame:
    """Done files and bytes per category."""
    return (
        entries.filter(rules.is_done(F.col("status")))
        .groupBy(rules.category(F.col("rel_path")).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    )


def junk_files(entries: DataFrame) -> DataFrame:
    reason = rules.junk_reason(F.col("rel_path"), F.col("size"))
    return (
        entries.filter(rules.is_done(F.col("status")))
        .select("rel_path", "size", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
        .withColumn("label", rules.reason_label(F.col("reason")))
    )


def text_candidates(entries: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Done files textual enough to be compared by content; with `max_bytes`, none larger than that."""
    done = rules.is_done(F.col("status"))
    return entries.filter(done & rules.is_text_candidate(F.col("rel_path"), F.col("size"), max_bytes))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per account; names with a leading underscore are no snapshots."""
    real = snapshots.filter(~F.startswith(F.col("snapshot"), F.lit("_")))
    return real.groupBy("account").agg(F.max("snapshot").alias("snapshot"))


def resume_target(snapshots: DataFrame, force_new: bool = False) -> DataFrame:
    """Per account: the snapshot to go on with (null starts a new one) and the complete one to reuse.

    `snapshots` carries account, snapshot and `complete`.
    """
    real = snapshots.filter(~F.startswith(F.col("snapshot"), F.lit("_")))
    picked = real.groupBy("account").agg(
        F.max("snapshot").alias("newest"),
        F.max(F.when(F.col("complete"), F.col("snapshot"))).alias("previous_complete"),
        F.max(F.when(~F.col("complete"), F.col("snapshot"))).alias("_open"),
    )
    resumes = (F.col("_open") == F.col("newest")) & F.lit(not force_new)
    return picked.select("account", F.when(resumes, F.col("newest")).alias("target"), "previous_complete")


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of every key. The rank filter is pushed below the shuffle, so a map task sends one
    row per key however many it holds."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")
