"""Where each account stands on the way from first backup to tidy copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def funnel_status(facts: DataFrame) -> DataFrame:
    """One row per account and stage: done, active, partial, todo or blocked.

    `facts` has one row per account: has_manifest, running, done, expected, errors, verify_clean,
    proposed, reorganized.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    complete = F.coalesce(
        (F.col("expected") > 0) & (F.col("done") >= F.col("expected")) & (F.col("errors") == 0), F.lit(False))
    waiting = F.when(flag("has_manifest"), "todo").otherwise("blocked")
    stages = {
        "backup": F.when(complete, "done").when(flag("running"), "active").when(flag("has_manifest"), "partial")
        .otherwise("todo"),
        "verify": F.when(flag("verify_clean"), "done").otherwise(waiting),
        "propose": F.when(flag("proposed"), "done").otherwise(waiting),
        "reorganize": F.when(flag("reorganized"), "done")
        .otherwise(F.when(flag("verify_clean"), "todo").otherwise("blocked")),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("stage"), status.alias("status")) for name, status in stages.items()])
    return facts.select("account", F.inline(rows))
