"""Verification of copies against a catalog, and the gate destructive steps must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filecensus.functions import rules
from filecensus.operators.catalog import completeness_columns

OUTCOMES = ["ok", "missing", "size_mismatch", "hash_mismatch"]


def _against_tree(entries: DataFrame, tree: DataFrame, check_hash: bool) -> DataFrame:
    """Entries with `outcome`: the first test a file fails, cheap tests first.

    A file that cannot be read, or whose hash is asked for but unknown, fails the hash test.
    """
    found = tree.select(
        "rel_path", F.col("size").alias("_size"), F.col("sha256").alias("_sha256"),
        F.col("readable").alias("_readable"), F.lit(True).alias("_found"))
    hashed = F.lit(check_hash) & (F.col("sha256") != "")
    same = F.coalesce(F.col("_readable") & (F.col("_sha256") == F.col("sha256")), F.lit(False))
    outcome = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("_size").isNull(), "hash_mismatch")
        .when(F.col("_size") != F.col("size"), "size_mismatch")
        .when(hashed & ~same, "hash_mismatch")
        .otherwise("ok")
    )
    joined = entries.join(found, "rel_path", "left").withColumn("outcome", outcome)
    return joined.withColumn("hash_unchecked", (F.col("outcome") == "ok") & ~hashed)


def to_hash(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """Paths worth reading: done, hashed, present and of the right size."""
    wanted = entries.filter(rules.is_done(F.col("status")) & (F.col("sha256") != "")).select("rel_path", "size")
    return tree.join(wanted, ["rel_path", "size"], "left_semi")


def verify_detail(entries: DataFrame, tree: DataFrame, check_hash: bool = True) -> DataFrame:
    """One row per done file: ok, missing, size_mismatch or hash_mismatch."""
    done = entries.filter(rules.is_done(F.col("status")))
    return _against_tree(done, tree, check_hash).select(
        "ordinal", "rel_path", "size", "outcome", "hash_unchecked")


def verify_summary(entries: DataFrame, tree: DataFrame, expected_total: Column, check_hash: bool = True) -> DataFrame:
    """One row: counts per outcome, completeness and whether the copy is clean."""
    status, outcome = F.col("status"), F.col("outcome")
    done = rules.is_done(status)
    counts = _against_tree(entries, tree, check_hash).agg(
        F.count_if(done).alias("total"),
        *[F.count_if(done & (outcome == name)).alias(name) for name in OUTCOMES],
        F.count_if(done & F.col("hash_unchecked")).alias("hash_unchecked"),
        F.count_if(rules.is_restricted(status)).alias("restricted"),
        F.count_if(rules.is_failed(status)).alias("_failed"),
    )
    complete = completeness_columns(F.col("_failed"), F.col("restricted"), F.col("total"), expected_total)
    settled = counts.select(
        "total", *OUTCOMES, "hash_unchecked", "restricted", complete["complete"].alias("complete"),
        complete["reason"].alias("complete_reason"))
    clean = (F.col("total") > 0) & F.col("complete") & (F.col("ok") == F.col("total"))
    return settled.withColumn("clean", clean)


def safety_gate(entries: DataFrame, expected_total: Column, primary_tree: DataFrame,
                external_tree: DataFrame | None, require_external: bool = True) -> DataFrame:
    """One row (safe, reason): both copies are verified against the primary's catalog."""
    sides = verify_summary(entries, primary_tree, expected_total).select(F.lit("primary").alias("side"), "clean")
    if require_external and external_tree is not None:
        external = verify_summary(entries, external_tree, expected_total)
        sides = sides.unionByName(external.select(F.lit("external").alias("side"), "clean"))
    clean = sides.agg(
        F.bool_or((F.col("side") == "primary") & F.col("clean")).alias("_primary"),
        F.bool_or((F.col("side") == "external") & F.col("clean")).alias("_external"),
    )
    needed = F.lit(require_external)
    reason = (
        F.when(~F.col("_primary"), "primary_not_verified")
        .when(needed & F.lit(external_tree is None), "no_external_mirror")
        .when(needed & ~F.col("_external"), "external_not_verified")
        .otherwise("verified")
    )
    return clean.select((reason == "verified").alias("safe"), reason.alias("reason"))


def mirror_repair_plan(entries: DataFrame, trees: DataFrame, destinations: list[str]) -> DataFrame:
    """Copies to make so that every destination holds every done file at its right size.

    `trees` lists (dest, rel_path, size). The donor is the first healthy destination; without one
    the file has to be fetched again.
    """
    done = entries.filter(rules.is_done(F.col("status"))).select("ordinal", "rel_path", "size")
    # At most one element per destination and path.
    copies = trees.groupBy("rel_path").agg(F.collect_set(F.struct("dest", "size")).alias("_copies"))
    every = F.array(*[F.lit(d) for d in destinations])
    matching = F.filter(F.coalesce(F.col("_copies"), F.array()), lambda c: c["size"] == F.col("size"))
    healthy = F.transform(matching, lambda c: c["dest"])
    joined = done.join(copies, "rel_path", "left").withColumn("_healthy", healthy)
    donor = F.get(F.filter(every, lambda d: F.array_contains(F.col("_healthy"), d)), F.lit(0))
    return joined.select(
        "ordinal", "rel_path", "size", donor.alias("donor"),
        F.explode(F.array_except(every, F.col("_healthy"))).alias("dest"))


def capacity_check(required: DataFrame, destinations: list[tuple[str, int]], margin_gb: float) -> DataFrame:
    """Whether each destination has room for `required_bytes` (one row) and the margin."""
    margin = int(margin_gb * 1024 ** 3)
    places = F.array(*[F.struct(F.lit(d).alias("destination"), F.lit(int(free)).cast("bigint").alias("free_bytes"))
                       for d, free in destinations])
    rows = required.select(
        F.inline(places), "required_bytes").withColumn("margin_bytes", F.lit(margin).cast("bigint"))
    needed = F.col("required_bytes") + F.col("margin_bytes")
    return rows.select(
        "*", (F.col("free_bytes") >= needed).alias("ok"),
        F.greatest(F.lit(0), needed - F.col("free_bytes")).alias("shortfall_bytes"))
