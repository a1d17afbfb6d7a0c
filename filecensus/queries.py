"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from filecensus.bridge import spark_view
from filecensus.functions import rules, text
from filecensus.functions.vectors import cosine
from filecensus.operators.scale import cut_lineage, new_table
from filecensus.operators import catalog, diff, duplicates, failures, naming, near, progress, tree, verify
from filecensus.plans import funnel, layout, proposal, purge
from filecensus.schemas import ENTRY_COLUMNS
from filecensus.sources import listings, plans, snapshots, trees
from filecensus.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Scenario settings shared with the SQL checks.
NEAR_THRESHOLD = 0.40
TEXT_THRESHOLD = 0.998
LETTERS = "abcdefghijklmnopqrstuvwxyz"
RUN_LIMIT = 8
AS_OF = "2024-01-30 12:00:00"
LIVE_SECONDS = 6 * 3600
ANSWER_CATEGORIES = ["Nation", "vision", "MENT", "que"]
MIRRORS = ["primary", "ext", "offsite"]
DESTINATIONS = [("primary", 60_000_000), ("ext", 2_000_000), ("offsite", 5_000_000_000)]
MARGIN_GB = 0.01

EDITED_PLAN = """
SELECT ordinal * 2 AS plan_ordinal,
       CASE ordinal % 17 WHEN 3 THEN '  Skip ' WHEN 5 THEN 'QUARANTINE' WHEN 7 THEN '' ELSE action END AS action,
       src_rel,
       CASE ordinal % 19 WHEN 2 THEN concat('Sorted//./', src_rel) WHEN 4 THEN ''
                         WHEN 6 THEN concat('_quarantine/', src_rel) ELSE dest_rel END AS dest_rel
FROM {plan} WHERE src_rel NOT LIKE 'src5/%'
UNION ALL
SELECT ordinal * 2 + 1, 'keep', src_rel, 'Second thoughts/file.txt' FROM {plan} WHERE src_rel LIKE '%/fr/%'
"""
DRAFT_PLAN = """
SELECT plan_ordinal, CASE plan_ordinal % 31 WHEN 0 THEN 'delete' WHEN 2 THEN ' ' ELSE action END AS action,
       CASE plan_ordinal % 53 WHEN 0 THEN '' WHEN 2 THEN concat('lost/', src_rel) ELSE src_rel END AS src_rel,
       CASE plan_ordinal % 37 WHEN 0 THEN '../outside/evil.bin' WHEN 2 THEN '/etc/passwd' WHEN 4 THEN '   '
                              WHEN 6 THEN '_Quarantine/x' WHEN 8 THEN 'a/../../b' ELSE dest_rel END AS dest_rel
FROM {edited}
"""


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- inputs ------------------------------------------------------------------------------------

def _classified(spark, folder):
    return proposal.classify(spark_view(spark, folder, "catalog"))


def _edited_plan(spark, folder):
    """A plan is a stored table by the time it is applied."""
    return cut_lineage(
        spark_view(spark, folder, EDITED_PLAN, plan=proposal.default_plan(_classified(spark, folder))))


def _as_items(rows):
    parents = F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>"))
    listed = rows.withColumn("parents", parents).withColumn("owners", F.array().cast("array<string>"))
    return listed.drop("parent", "rk")


def _items(spark, folder):
    """A listing is a stored table by the time it is walked."""
    return cut_lineage(_as_items(spark_view(spark, folder, "items")))


def _heartbeats(spark, folder):
    return spark_view(spark, folder, "heartbeats")


def _expected(spark, folder):
    """Listed files of the settled catalog, counted from the table."""
    return F.lit(spark_view(spark, folder, "settled").count())


# --- catalog -----------------------------------------------------------------------------------

@query
def status_counts(spark, folder):
    return catalog.status_counts(spark_view(spark, folder, "catalog"))


@query
def completeness(spark, folder):
    entries = spark_view(spark, folder, "snapshot_entries")
    return catalog.completeness(entries, spark_view(spark, folder, "snapshots"), ["o_orderkey"])


@query
def latest_snapshot(spark, folder):
    return catalog.latest_snapshot(spark_view(spark, folder, "snapshots"))


@query
def resume_target(spark, folder):
    snapshots = spark_view(spark, folder, "snapshots")
    complete = completeness(spark, folder).select("o_orderkey", "complete")
    return catalog.resume_target(snapshots.join(complete, "o_orderkey"))


@query
def upsert_entries(spark, folder):
    return catalog.upsert(spark_view(spark, folder, "entry_log"))


@query
def prune_stale(spark, folder):
    kept = catalog.prune_stale(spark_view(spark, folder, "previous"), spark_view(spark, folder, "catalog"))
    return kept.select("file_id", "status")


@query
def listed_missing(spark, folder):
    missing = catalog.listed_missing(spark_view(spark, folder, "previous"), spark_view(spark, folder, "catalog"))
    return missing.select("ordinal", "file_id", "rel_path")


@query
def listing_totals(spark, folder):
    rows = spark_view(spark, folder, "catalog")
    return catalog.listing_totals(rows, rows)


@query
def by_category(spark, folder):
    return catalog.by_category(spark_view(spark, folder, "catalog"))


@query
def junk_files(spark, folder):
    return catalog.junk_files(spark_view(spark, folder, "catalog"))


@query
def text_candidates(spark, folder):
    return catalog.text_candidates(spark_view(spark, folder, "catalog")).select("ordinal", "rel_path", "size")


@query
def safe_names(spark, folder):
    raw = spark_view(spark, folder, """
SELECT 'page' AS origin, page_id AS id, url AS name FROM {pages}
UNION ALL SELECT 'document', doc_id, text FROM {documents}""")
    return raw.select("origin", "id", text.safe_component(F.col("name")).alias("safe"))


@query
def clean_accounts(spark, folder):
    pages = spark_view(spark, folder, "SELECT page_id, url FROM {pages}")
    return pages.select("page_id", text.clean_account(F.col("url")).alias("account"))


@query
def answer_category(spark, folder):
    turns = spark_view(spark, folder, "SELECT conv_id, turn, text FROM {conversations}")
    return turns.select("conv_id", "turn", text.answer_category(F.col("text"), ANSWER_CATEGORIES).alias("category"))


@query
def native_exports(spark, folder):
    items = spark_view(spark, folder, "items").filter(rules.is_native(F.col("mime_type")))
    exported = items.withColumn("_e", rules.native_export(F.col("mime_type"), "office")).filter("_e IS NOT NULL")
    return exported.select("id", "mime_type", F.col("_e.mime").alias("export_mime"),
                           F.col("_e.extension").alias("extension"))


# --- listing walk ------------------------------------------------------------------------------

@query
def build_paths(spark, folder):
    items = _items(spark, folder)
    return tree.build_paths(items, items).select("source_ordinal", "id", "rel_path")


@query
def expand_folders(spark, folder):
    items = _items(spark, folder)
    roots = items.filter("size(parents) = 0 AND NOT shared_with_me")
    children = items.filter("size(parents) > 0").withColumn("folder_id", F.get("parents", F.lit(0)))
    return tree.expand_folders(roots, children).select("id", "folder_id", F.size("visit").alias("depth"))


@query
def walk(spark, folder):
    files = tree.walk(_items(spark, folder))
    return files.select("file_id", "rel_path", "drive_name", "size", "is_native", "exported_as")


@query
def walk_shared(spark, folder):
    """A listing whose shared folders are walked into. It and their contents are parts of one stored table."""
    items = cut_lineage(spark_view(spark, folder, "items"))
    listing, contents = (
        _as_items(spark_view(spark, folder, view, items=items)) for view in ("shared_listing", "shared_children"))
    files = tree.walk(listing, children=contents)
    return files.select("file_id", "rel_path", "drive_name", "size", "is_native", "exported_as")


# --- duplicates --------------------------------------------------------------------------------

@query
def exact_duplicates(spark, folder):
    return duplicates.exact_duplicates(spark_view(spark, folder, "catalog"))


@query
def duplicate_members(spark, folder):
    return duplicates.duplicate_members(spark_view(spark, folder, "catalog"))


@query
def dedup_summary(spark, folder):
    return duplicates.dedup_summary(exact_duplicates(spark, folder))


@query
def orphaned_by_junk(spark, folder):
    return duplicates.orphaned_by_junk(spark_view(spark, folder, "catalog"))


@query
def near_members(spark, folder):
    members = near.near_members(spark_view(spark, folder, "vectors"), NEAR_THRESHOLD)
    return members.select("ordinal", "anchor", F.round("similarity", 6).alias("similarity"))


@query
def near_duplicates(spark, folder):
    return near.near_duplicates(near.near_members(spark_view(spark, folder, "vectors"), NEAR_THRESHOLD))


@query
def near_similarity(spark, folder):
    """Similarities of the members to their anchors, from the vectors themselves."""
    vectors = spark_view(spark, folder, "vectors").select("ordinal", "embedding")
    anchors = vectors.toDF("anchor", "_anchor")
    members = near.near_members(spark_view(spark, folder, "vectors"), NEAR_THRESHOLD).select("ordinal", "anchor")
    pairs = members.join(vectors, "ordinal").join(anchors, "anchor")
    return pairs.select("ordinal", "anchor", F.round(cosine(F.col("embedding"), F.col("_anchor")), 6).alias("similarity"))


@query
def near_texts(spark, folder):
    """Files in, groups out: texts are read in parts from the files written for them."""
    root = _written(spark, folder)
    candidates = catalog.text_candidates(spark_view(spark, folder, "catalog"))
    return near.near_duplicates(near.near_texts(candidates, root, _letters, TEXT_THRESHOLD, 4096))


@query
def all_duplicate_groups(spark, folder):
    files = catalog.text_candidates(spark_view(spark, folder, "catalog"))
    vectors = spark_view(spark, folder, "vectors").select("ordinal", "embedding")
    members = near.near_members(files.join(vectors, "ordinal"), NEAR_THRESHOLD)
    return duplicates.all_groups(exact_duplicates(spark, folder), near.near_duplicates(members))


# --- proposal and layout -----------------------------------------------------------------------

@query
def proposal_summary(spark, folder):
    return proposal.proposal_summary(_classified(spark, folder))


@query
def proposal_rollup(spark, folder):
    return proposal.proposal_rollup(_classified(spark, folder))


@query
def rollup_by_year(spark, folder):
    return proposal.rollup_by_year(proposal_rollup(spark, folder))


@query
def rollup_bars(spark, folder):
    return proposal.rollup_bars(proposal_rollup(spark, folder))


@query
def default_plan(spark, folder):
    return proposal.default_plan(_classified(spark, folder))


@query
def unique_paths(spark, folder):
    rows = spark_view(spark, folder, "SELECT ordinal, file_id, listed_path FROM {catalog}")
    tagged = rows.withColumn("tag", text.id_tag(F.col("file_id")))
    return naming.unique_paths(tagged, "listed_path", "tag").select("ordinal", "unique_path")


@query
def route_default(spark, folder):
    return layout.route_default(_classified(spark, folder))


def _existing(spark, folder):
    plan = proposal.default_plan(_classified(spark, folder))
    return plan.filter("dest_rel LIKE 'Documents/%'").select(F.lower("dest_rel").alias("path")).distinct()


@query
def route_into_existing(spark, folder):
    return layout.route_default(_classified(spark, folder), _existing(spark, folder))


@query
def route_with_plan(spark, folder):
    return layout.route_with_plan(spark_view(spark, folder, "catalog"), _edited_plan(spark, folder))


@query
def apply_plan(spark, folder):
    applied = layout.apply_plan(spark_view(spark, folder, "catalog"), _edited_plan(spark, folder))
    return applied.select("ordinal", "src_rel", "action", "wanted")


@query
def plan_validation(spark, folder):
    draft = spark_view(spark, folder, DRAFT_PLAN, edited=_edited_plan(spark, folder))
    return layout.plan_validation(draft, spark_view(spark, folder, "catalog"))


@query
def unplanned_files(spark, folder):
    return layout.unplanned_files(spark_view(spark, folder, "catalog"), _edited_plan(spark, folder))


@query
def routing_summary(spark, folder):
    return layout.routing_summary(route_default(spark, folder))


@query
def mapping_sample(spark, folder):
    return layout.mapping_sample(route_default(spark, folder))


# --- comparison and verification ---------------------------------------------------------------

def _diff(spark, folder):
    listing = spark_view(spark, folder, "SELECT ordinal, file_id, listed_path, mime_type, modified_time, size FROM {catalog}")
    started = spark_view(spark, folder, "SELECT file_id, status, rel_path FROM {catalog} WHERE drive_id = 'src1'")
    return diff.incremental_diff(listing, started, spark_view(spark, folder, "previous"))


@query
def incremental_diff(spark, folder):
    return _diff(spark, folder).select("ordinal", "file_id", "outcome", "previous_path")


@query
def import_plan(spark, folder):
    return diff.import_plan(_diff(spark, folder), spark_view(spark, folder, "previous_tree"))


@query
def assign_paths(spark, folder):
    started = spark_view(spark, folder, "SELECT status, listed_path AS rel_path FROM {catalog} WHERE drive_id = 'src1'")
    pending = _diff(spark, folder).withColumnRenamed("listed_path", "rel_path")
    return diff.assign_paths(pending, started).select("ordinal", "outcome", "local_path")


@query
def verify_detail(spark, folder):
    return verify.verify_detail(spark_view(spark, folder, "catalog"), spark_view(spark, folder, "mirror"))


@query
def verify_summary(spark, folder):
    return verify.verify_summary(
        spark_view(spark, folder, "catalog"), spark_view(spark, folder, "mirror"), _expected(spark, folder))


@query
def safety_gate(spark, folder):
    return verify.safety_gate(
        spark_view(spark, folder, "settled"), _expected(spark, folder), spark_view(spark, folder, "primary_tree"),
        spark_view(spark, folder, "mirror"))


@query
def mirror_repair_plan(spark, folder):
    return verify.mirror_repair_plan(
        spark_view(spark, folder, "catalog"), spark_view(spark, folder, "mirror_trees"), MIRRORS)


@query
def capacity_check(spark, folder):
    return verify.capacity_check(listing_totals(spark, folder), DESTINATIONS, MARGIN_GB)


@query
def purge_plan(spark, folder):
    settled = spark_view(spark, folder, "settled")
    gate = verify.safety_gate(
        settled, _expected(spark, folder), spark_view(spark, folder, "primary_tree"),
        spark_view(spark, folder, "intact_mirror"))
    target = layout.route_default(proposal.classify(settled)).select(F.col("dest_rel").alias("rel_path"), "size")
    return purge.purge_plan(target, gate, "/estate/_clean/main", ["/estate/20240101/main", "/mirror/20240101/main"], True)


@query
def purge_summary(spark, folder):
    return purge.purge_summary(purge_plan(spark, folder))


# --- what sinks write, sources read back ---------------------------------------------------------

def _entries(spark, folder):
    return spark_view(spark, folder, "catalog").select(*ENTRY_COLUMNS)


@query
def snapshot_roundtrip(spark, folder):
    root = new_table(spark)
    snapshots.write_snapshot(_entries(spark, folder), "main", "20240101", 5, 7, [root])
    return snapshots.read_entries(spark, root, "main", "20240101").select(*ENTRY_COLUMNS)


@query
def header_roundtrip(spark, folder):
    root = new_table(spark)
    snapshots.write_snapshot(_entries(spark, folder), "main", "20240101", 5, 7, [root])
    return snapshots.read_headers(spark, root)


@query
def document_roundtrip(spark, folder):
    root = new_table(spark)
    snapshots.export_snapshot(_entries(spark, folder), "main", "20240101", 5, 7, root)
    good, _ = snapshots.document_entries(snapshots.read_documents(spark, f"{root}/*/*/*.json"))
    return good.select("account", "snapshot", *ENTRY_COLUMNS[1:])


@query
def plan_roundtrip(spark, folder):
    root = new_table(spark)
    plans.write_plan(default_plan(spark, folder), root)
    return plans.read_plan(spark, root)


def _written(spark, folder):
    """The folder with the files of the catalog."""
    root = trees.local_path(new_table(spark))
    trees.write_texts(spark_view(spark, folder, "texts"), root)
    return root


@F.pandas_udf(ArrayType(DoubleType()))
def _letters(texts: pd.Series) -> pd.Series:
    """A stand-in for a model: how often each letter from a to z occurs."""
    return texts.str.lower().map(lambda text: [float(text.count(letter)) for letter in LETTERS])


@query
def tree_roundtrip(spark, folder):
    return trees.list_tree(spark, _written(spark, folder)).select("rel_path", "size")


@query
def hash_roundtrip(spark, folder):
    return trees.hash_tree(spark, _written(spark, folder))


@query
def copy_roundtrip(spark, folder):
    """Hashes of the copies, and what the log of the copy says."""
    source, target = _written(spark, folder), trees.local_path(new_table(spark))
    routing = spark_view(spark, folder, """
SELECT ordinal, rel_path AS src_rel, concat('copy/', rel_path) AS dest_rel, CAST({len}(text) AS BIGINT) AS size
FROM {texts} WHERE ordinal % 3 <> 0 UNION ALL
SELECT -1 - ordinal, concat('lost/', rel_path), concat('lost/', rel_path), 1 FROM {texts} WHERE ordinal % 3 = 0""")
    log = trees.apply_copies(routing, source, target)
    found = trees.hash_tree(spark, target).select(F.col("rel_path").alias("dest_rel"), F.col("sha256").alias("on_disk"))
    return log.join(found, "dest_rel", "left").select(
        "ordinal", "dest_rel", "sha256", "on_disk", F.col("error").isNotNull().alias("failed"))


@query
def listing_roundtrip(spark, folder):
    items = _items(spark, folder)
    root = trees.local_path(new_table(spark))
    listings.dump_listing(items, f"{root}/pages", 100)
    listings.dump_drives(items.select("source_ordinal", "drive_id", "drive_name").distinct(), f"{root}/drives")
    sources = listings.read_sources(spark, f"{root}/drives")
    # The account's own sources have fixed places; the shared items are listed by the third here.
    sources = sources.withColumn("source_ordinal", F.when(F.col("shared_with_me"), 2).otherwise(F.col("source_ordinal")))
    read = listings.read_listing(spark, f"{root}/pages", sources)
    return read.select("source_ordinal", "drive_id", "drive_name", "shared_with_me", "id", "name", "mime_type",
                       F.get("parents", F.lit(0)).alias("parent"), "size", "modified_time", "shortcut_target")


@query
def report_roundtrip(spark, folder):
    path = new_table(spark)
    report = dedup_summary(spark, folder)
    plans.write_report(report, path, exact_duplicates(spark, folder))
    return plans.read_report(spark, path, report._jdf.schema().toDDL())


@query
def heartbeat_roundtrip(spark, folder):
    return replay.heartbeat_table(spark, folder).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- attempts and progress ---------------------------------------------------------------------

@query
def failure_classes(spark, folder):
    return failures.failure_classes(spark_view(spark, folder, "attempts"))


@query
def run_summary(spark, folder):
    return failures.run_summary(spark_view(spark, folder, "attempts"))


@query
def error_samples(spark, folder):
    return failures.error_samples(spark_view(spark, folder, "attempts"))


@query
def failure_runs(spark, folder):
    return failures.failure_runs(spark_view(spark, folder, "attempts"), RUN_LIMIT)


@query
def progress_snapshot(spark, folder):
    return progress.progress_snapshot(_heartbeats(spark, folder), spark_view(spark, folder, "headers"))


@query
def progress_rate(spark, folder):
    return progress.progress_rate(_heartbeats(spark, folder))


@query
def rate_history(spark, folder):
    return progress.rate_history(_heartbeats(spark, folder))


@query
def running_state(spark, folder):
    return progress.running_state(_heartbeats(spark, folder), F.lit(AS_OF).cast("timestamp"), LIVE_SECONDS)


@query
def throughput_windows(spark, folder):
    return progress.throughput_windows(spark_view(spark, folder, "attempts"))


@query
def funnel_status(spark, folder):
    state = progress_snapshot(spark, folder).select("account", "done", "expected", "errors", "source")
    live = running_state(spark, folder).select("account", (F.col("state") == "live").alias("running"))
    reports = spark_view(spark, folder, """
SELECT CAST(c_custkey AS STRING) AS account, c_acctbal > 0 AS verify_clean, c_acctbal > 2000 AS proposed,
       c_acctbal > 6000 AS reorganized FROM {customer}""")
    facts = state.join(live, "account", "left").join(reports, "account", "left")
    return funnel.funnel_status(facts.withColumn("has_manifest", F.col("verify_clean").isNotNull()))


# --- streams run to the end of the table -------------------------------------------------------

@query
def live_status(spark, folder):
    return replay.live_status(spark, folder)


@query
def live_throughput(spark, folder):
    return replay.live_throughput(spark, folder)


@query
def breaker_alerts(spark, folder):
    return replay.breaker_alerts(spark, folder, RUN_LIMIT)


@query
def live_catalog(spark, folder):
    return replay.live_catalog(spark, folder)


@query
def live_activity(spark, folder):
    return replay.live_activity(spark, folder)
