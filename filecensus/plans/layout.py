"""Layouts: where every file goes in the tidy copy, by default rules or by an edited plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filecensus.functions import measures, rules, text
from filecensus.operators.naming import unique_paths
from filecensus.operators.scale import HOT_ROWS, lookup, newest

ACTIONS = ["keep", "quarantine", "skip"]
_ROUTED = ["ordinal", "src_rel", "dest_rel", "kind", "size"]


def _settle(wanted: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Make the wanted destinations unique; equal names are told apart by content hash."""
    tagged = wanted.select(
        "ordinal", "src_rel", "wanted", "kind", "size", text.hash_tag(F.col("sha256")).alias("_hash_tag"))
    return unique_paths(tagged, "wanted", "_hash_tag", existing, "dest_rel").select(*_ROUTED)


def _present(entries: DataFrame, tree: DataFrame | None) -> DataFrame:
    return entries if tree is None else entries.join(tree.select("rel_path"), "rel_path", "left_semi")


def route_default(classified: DataFrame, existing: DataFrame | None = None, tree: DataFrame | None = None,
                  by_year: bool = True) -> DataFrame:
    """Destination of every done file: junk and copies to quarantine, the rest by category and year.

    `existing` lists paths already in the target, `tree` the source files really on disk.
    """
    name = text.base_name(F.col("rel_path"))
    verdict = F.col("verdict")
    wanted = (
        F.when(verdict == "junk", F.concat(F.lit("_quarantine/junk/"), name))
        .when(verdict == "duplicate", F.concat(F.lit("_quarantine/duplicates/"), name))
        .otherwise(rules.tidy_path(F.col("rel_path"), F.col("modified_time"), by_year))
    )
    kind = F.when(verdict == "clean", "copied").otherwise(verdict)
    rows = _present(classified, tree).select(
        "ordinal", F.col("rel_path").alias("src_rel"), "sha256", "size", kind.alias("kind"), wanted.alias("wanted"))
    return _settle(rows, existing)


def plan_action(action) -> F.Column:
    return F.lower(text.strip(text.or_default(action, "keep")))


def _last_rows(plan: DataFrame) -> DataFrame:
    """The plan row that counts for each source: the last one."""
    rows = plan.select("plan_ordinal", F.coalesce("src_rel", F.lit("")).alias("src_rel"), "action", "dest_rel")
    return newest(rows, ["src_rel"], "plan_ordinal").select(
        "src_rel", plan_action(F.col("action")).alias("action"), F.col("dest_rel").alias("plan_dest"))


def _in_quarantine(path) -> F.Column:
    return (path == "_quarantine") | F.startswith(path, F.lit("_quarantine/"))


def bad_destination(path) -> F.Column:
    """Absolute, blank, or climbing out of the tree."""
    climbs = F.array_contains(F.split(path, "/"), "..")
    return F.startswith(path, F.lit("/")) | climbs | (text.strip(path) == "")


def plan_validation(plan: DataFrame, entries: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every plan row with its first problem, if any, and its warnings.

    An unknown action is a problem in any row. A destination is checked where it would be used: in
    the row that counts for a done file that is not skipped.
    """
    done = entries.filter(rules.is_done(F.col("status"))).select(
        F.col("rel_path").alias("src_rel"), F.lit(True).alias("_matched"))
    rows = plan.select(
        "plan_ordinal", F.coalesce("src_rel", F.lit("")).alias("src_rel"),
        plan_action(F.col("action")).alias("action"), F.coalesce("dest_rel", F.lit("")).alias("dest_rel"))
    # Any number of rows may share a source, above all the empty one.
    sources = rows.groupBy("src_rel").agg(F.count(F.lit(1)).alias("_n"), F.max("plan_ordinal").alias("_last"))
    joined = lookup(rows, sources.join(done, "src_rel", "left"), ["src_rel"], "_n", F.col("plan_ordinal"), hot_rows)
    counts = F.col("_last") == F.col("plan_ordinal")
    used = counts & F.col("_matched") & F.col("action").isin("keep", "quarantine")
    outside = used & (F.col("dest_rel") != "") & bad_destination(F.col("dest_rel"))
    known = F.col("action").isin(ACTIONS)
    target = text.normal_path(F.col("dest_rel"))
    other_case = _in_quarantine(F.lower(target)) & ~_in_quarantine(target) & (F.col("action") == "keep")
    return joined.select(
        "plan_ordinal", "src_rel", "action",
        F.when(~known, "unknown_action").when(outside, "bad_destination").alias("problem"),
        other_case.alias("warn_case"),
        (F.col("src_rel") == "").alias("empty_source"),
        (~counts).alias("superseded"),
        F.col("_matched").isNull().alias("no_file"),
    )


def apply_plan(entries: DataFrame, plan: DataFrame, by_year: bool = True) -> DataFrame:
    """Done files the plan names, with the action and the destination it asks for."""
    done = entries.filter(rules.is_done(F.col("status"))).withColumnRenamed("rel_path", "src_rel")
    joined = done.join(_last_rows(plan), "src_rel")
    tidy = rules.tidy_path(F.col("src_rel"), F.col("modified_time"), by_year)
    asked = text.normal_path(F.when(F.length("plan_dest") > 0, F.col("plan_dest")).otherwise(tidy))
    name = text.base_name(F.col("src_rel"))
    quarantined = F.when(_in_quarantine(asked), asked).otherwise(F.concat(F.lit("_quarantine/"), asked))
    kept = F.when(_in_quarantine(asked), F.concat(F.lit("Kept/"), name)).otherwise(asked)
    wanted = F.when(F.col("action") == "quarantine", quarantined).when(F.col("action") == "keep", kept)
    return joined.select("ordinal", "src_rel", "sha256", "size", "action", wanted.alias("wanted"))


def route_with_plan(entries: DataFrame, plan: DataFrame, existing: DataFrame | None = None,
                    tree: DataFrame | None = None, by_year: bool = True) -> DataFrame:
    """Destinations under an edited plan. The whole plan is checked before anything is routed."""
    problems = plan_validation(plan, entries).filter("problem IS NOT NULL")
    first = problems.orderBy("plan_ordinal").limit(1).collect()
    if first:
        raise ValueError(f"plan row {first[0]['plan_ordinal']}: {first[0]['problem']}")
    rows = apply_plan(_present(entries, tree), plan, by_year).filter("action <> 'skip'")
    clutter = F.contains(F.col("wanted"), F.lit("_quarantine/junk"))
    kind = F.when(F.col("action") == "keep", "copied").when(clutter, "junk").otherwise("duplicate")
    return _settle(rows.withColumn("kind", kind), existing)


def unplanned_files(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """Done files no plan row names; they are not copied."""
    named = plan.select(F.coalesce("src_rel", F.lit("")).alias("rel_path")).distinct()
    done = entries.filter(rules.is_done(F.col("status")))
    return done.join(named, "rel_path", "left_anti").select("ordinal", "rel_path", "size")


def routing_summary(routing: DataFrame) -> DataFrame:
    kind, size = F.col("kind"), F.col("size")
    copied = kind == "copied"
    sums = routing.agg(
        F.count_if(copied).alias("copied"),
        F.count_if(kind == "duplicate").alias("quarantined_dup"),
        F.count_if(kind == "junk").alias("quarantined_junk"),
        F.coalesce(F.sum(F.when(copied, size)), F.lit(0)).alias("bytes_copied"),
        F.coalesce(F.sum(F.when(~copied, size)), F.lit(0)).alias("bytes_quarantined"),
    )
    return sums.withColumn("gb", measures.in_units(F.col("bytes_copied"), measures.GIB, 3))


def mapping_sample(routing: DataFrame, rows: int = 50) -> DataFrame:
    """The first routed files, as the report shows them."""
    return routing.orderBy("ordinal").limit(rows).select("ordinal", "src_rel", "dest_rel")


def check_roots(source: str, target: str) -> None:
    """The tidy copy must lie outside the source mirror, and the other way round."""
    from pathlib import PurePosixPath

    a, b = PurePosixPath(source), PurePosixPath(target)
    if a == b or a in b.parents or b in a.parents:
        raise ValueError("the target must lie outside the source mirror")
