"""Purge plans: what could be removed from quarantine once every safety gate passes."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, functions as F


class UnsafePurge(Exception):
    """A safety precondition is not met."""


def external_mirror(primary: str, backup_root: str, mirror_root: str) -> str:
    """The mirror's copy of `primary`: the same place below the mirror root."""
    try:
        return str(PurePosixPath(mirror_root) / PurePosixPath(primary).relative_to(backup_root))
    except ValueError:
        raise UnsafePurge(f"{primary} does not lie below {backup_root}") from None


def purge_plan(tree: DataFrame, gate: DataFrame, target: str, mirrors: list[str], confirm: bool) -> DataFrame:
    """Files below the target's quarantine, deepest path names first. Nothing is deleted here.

    `gate` is the one-row result of `safety_gate`.
    """
    place = PurePosixPath(target)
    for mirror in map(PurePosixPath, mirrors):
        if place == mirror or mirror in place.parents:
            raise UnsafePurge(f"{target} belongs to the mirror {mirror}")
    if not confirm:
        raise UnsafePurge("confirmation is missing")
    verdict = gate.first()
    if not verdict["safe"]:
        raise UnsafePurge(f"backup not verified: {verdict['reason']}")
    return (
        tree.filter(F.startswith(F.col("rel_path"), F.lit("_quarantine/")))
        .select("rel_path", "size")
        .orderBy(F.desc("rel_path"))
    )


def purge_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed_bytes"))
