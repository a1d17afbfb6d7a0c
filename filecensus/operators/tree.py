"""Folder trees: paths from parent links, and everything below shared folders."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, functions as F

from filecensus.functions import rules, text
from filecensus.operators.catalog import first_seen
from filecensus.operators.scale import (
    HOT_ROWS, cut_lineage, cut_lineage_counted, lookup, lookup_unweighted, new_table, newest, numbered)

# Sorts compare the first bytes of the first key, which tell ids apart and sources hardly.
_NODE = ["id", "source_ordinal"]


def _component() -> Column:
    return text.safe_component(F.coalesce(F.col("name"), F.col("id")))


def _inner_nodes(items: DataFrame) -> tuple[DataFrame, int]:
    """(source_ordinal, id, up, name) of the ids that are somebody's parent, and how many rows the one with the most has.

    An id listed twice in a source is what its last listing says; links that leave the source are
    dropped. The rows of inner nodes are written before they are joined with each other, so all rows are shuffled once.
    """
    links = items.select("source_ordinal", "id", F.get("parents", F.lit(0)).alias("up"), "name", "position")
    used = links.filter("up IS NOT NULL").groupBy("source_ordinal", F.col("up").alias("id")).agg(
        F.count(F.lit(1)).alias("_below"))
    listed, seen = cut_lineage_counted(links.join(used, _NODE), most=F.max("_below"))
    nodes = newest(listed.drop("_below"), _NODE, "position")
    nodes = nodes.select("source_ordinal", "id", "up", F.coalesce("name", "id").alias("name"))
    known = nodes.select("source_ordinal", F.col("id").alias("up"), F.lit(True).alias("_known"))
    linked = nodes.join(known, ["up", "source_ordinal"], "left")
    return linked.select(
        "source_ordinal", "id", F.when(F.col("_known"), F.col("up")).alias("up"),
        text.safe_component(F.col("name")).alias("name")), seen["most"] or 0


def folder_paths(items: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """(source_ordinal, id, segments, ids): every inner node's chain of names, root first. Besides, how many rows of
    `items` the node with the most has for children.

    Pointer doubling: a tree of depth d takes log2(d) rounds of one write each. A chain that runs into
    a cycle ends before the first id it would pass again. Cycles are found by doubling too, cut open at
    their smallest id, chained like trees, and completed by the rest of the ring.
    """
    inner, most = _inner_nodes(items)
    nodes, seen = cut_lineage_counted(inner, n=F.count(F.lit(1)), unfinished=F.count("up"))
    finished, looped = _chained(nodes, seen, hot_rows)
    if looped is None:
        return finished, most
    links, links_seen = cut_lineage_counted(nodes.join(looped, _NODE, "left_semi"), n=F.count(F.lit(1)))
    ring = cut_lineage(_rings(links, links_seen["n"], hot_rows))
    opened = links.join(ring.withColumnRenamed("root", "_root"), _NODE, "left")
    is_root = F.coalesce(F.col("_root") == F.col("id"), F.lit(False))
    cut_open, cut_seen = cut_lineage_counted(
        opened.select(*_NODE, F.when(~is_root, F.col("up")).alias("up"), "name"),
        n=F.count(F.lit(1)), unfinished=F.count("up"))
    chains, _ = _chained(cut_open, cut_seen, hot_rows)
    # Above the root of a ring stands its last node, whose chain is the whole ring.
    last = opened.filter(is_root).select("source_ordinal", F.col("up").alias("id"), F.col("id").alias("root"))
    whole = chains.join(last, _NODE).select(
        "source_ordinal", "root", F.col("segments").alias("_segments"), F.col("ids").alias("_ids"))
    rooted = chains.withColumn("root", F.get("ids", F.lit(0)))
    joined = lookup_unweighted(rooted, whole, ["source_ordinal", "root"], F.col("id"), hot_rows, links_seen["n"])
    passed = F.size(F.array_intersect("ids", "_ids"))
    rest = [F.slice(c, passed + 1, F.size("_ids") - passed) for c in ("_segments", "_ids")]
    return finished.unionByName(joined.select(
        *_NODE, F.concat(rest[0], "segments").alias("segments"), F.concat(rest[1], "ids").alias("ids"))), most


def _chained(nodes: DataFrame, seen: dict, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Chains of the nodes that lead to a root, and the nodes that lead into a cycle, if there are any.

    Each round joins the unfinished nodes with the chains found so far; what is finished is not written
    again. `seen` says how many nodes there are and how many have a parent. When a round finishes
    nothing, no unfinished node has a finished one ahead.
    """
    keys = ["up", "source_ordinal"]
    state = nodes.select(*_NODE, "up", F.array("name").alias("segments"), F.array("id").alias("ids"))
    done, left, before = [], seen["unfinished"], None
    while True:
        done.append(state.filter("up IS NULL").drop("up"))
        unfinished = state.filter("up IS NOT NULL")
        if not left or left == before:
            return functools.reduce(DataFrame.union, done), unfinished.select(*_NODE) if left else None
        before = left
        # A chain that is as long as the round's step ends in a node of any earlier round, or is still open.
        roots = functools.reduce(DataFrame.union, done).withColumn("up", F.lit(None).cast("string"))
        ahead = unfinished.unionByName(roots).select(
            "source_ordinal", F.col("id").alias("up"), F.col("up").alias("_up"),
            F.col("segments").alias("_segments"), F.col("ids").alias("_ids"))
        joined = lookup_unweighted(unfinished, ahead, keys, F.col("id"), hot_rows, left)
        state, found = cut_lineage_counted(
            joined.select(*_NODE, F.col("_up").alias("up"), F.concat("_segments", "segments").alias("segments"),
                          F.concat("_ids", "ids").alias("ids")), unfinished=F.count("up"))
        left = found["unfinished"]


def _rings(links: DataFrame, count: int, hot_rows: int) -> DataFrame:
    """(source_ordinal, id, root) of the nodes on cycles; root is the cycle's smallest id.

    After as many steps as there are nodes every pointer stands on a cycle, and on every node of it.
    """
    keys = ["source_ordinal", "jump"]
    state = links.select(*_NODE, F.col("up").alias("jump"), F.least("id", "up").alias("least"))
    for _ in range(count.bit_length()):
        ahead = state.select("source_ordinal", F.col("id").alias("jump"), F.col("jump").alias("_jump"),
                             F.col("least").alias("_least"))
        joined = lookup_unweighted(state, ahead, keys, F.col("id"), hot_rows, count)
        state = cut_lineage(joined.select(
            *_NODE, F.col("_jump").alias("jump"), F.least("least", "_least").alias("least")))
    on_cycle = state.select("source_ordinal", F.col("jump").alias("id")).distinct()
    return state.join(on_cycle, _NODE, "left_semi").select(*_NODE, F.col("least").alias("root"))


def build_paths(rows: DataFrame, items: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add `rel_path` to `rows` of the listing `items`: drive name and parent chain, resolved inside the
    same source.

    Only inner nodes are chained; every other row is its parent's path plus its own name. `rows` are rows of
    `items`, each at most once, so no parent is asked for more often than it has children there. `items` should be a
    stored table: it is read twice.
    """
    up = F.get("parents", F.lit(0))
    # Rows without a parent ask for their place, so that they do not meet in one task; what they find is not used.
    own = rows.select(
        "*", _component().alias("_own"), (up.isNull() | (up == F.col("id"))).alias("_top"),
        F.coalesce(up, F.col("position").cast("string")).alias("_asks"))
    chains, most = folder_paths(items, hot_rows)
    keys = ["_asks", "source_ordinal"]
    above = chains.select("source_ordinal", F.col("id").alias("_asks"), F.col("segments").alias("_segments"),
                          F.col("ids").alias("_ids"))
    joined = lookup_unweighted(own, above, keys, F.col("id"), hot_rows, most)
    # A row that is met again on its parents' chain stops there: its chain ends below itself.
    again = F.coalesce(F.array_position("_ids", F.col("id")), F.lit(0)).cast("int")
    below = F.slice("_segments", again + 1, F.size("_segments"))
    folders = F.when(F.col("_top"), F.array().cast("array<string>")).otherwise(
        F.coalesce(below, F.array().cast("array<string>")))
    drive = text.safe_component(F.col("drive_name"))
    path = F.concat(drive, F.lit("/"), F.array_join(F.concat(folders, F.array("_own")), "/"))
    return joined.select(*rows.columns, path.alias("rel_path"))


def expand_folders(roots: DataFrame, children: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every item below the given folders, at any depth; each folder is opened once.

    `roots` and `children` are listing items; `children` also has `folder_id`. The rounds carry
    folder ids only; the items are picked up in one pass at the end. `visit` orders the result:
    within a level, later folders are opened first.
    """
    is_folder = F.col("mime_type") == rules.FOLDER_TYPE
    edges = children.filter(is_folder).select("folder_id", "id", "position")
    weights, held = cut_lineage_counted(
        children.groupBy("folder_id").agg(F.count_if(is_folder).alias("_n"), F.count(F.lit(1)).alias("_all")),
        folders=F.max("_n"), items=F.max("_all"))
    weights = weights.filter("_n > 0").drop("_all")
    first = roots.filter(is_folder).select(F.col("id").alias("folder_id"), F.array(-F.col("position")).alias("visit"))
    frontier, spark, seen = first, roots.sparkSession, new_table(roots.sparkSession)
    for level in itertools.count():
        fresh = frontier.groupBy("folder_id").agg(F.min("visit").alias("visit"))
        if level:
            fresh = fresh.join(opened.select("folder_id"), "folder_id", "left_anti")
        fresh.write.parquet(f"{seen}/level={level}")
        opened = spark.read.schema("folder_id string, visit array<bigint>, level int").parquet(seen)
        latest = opened.filter(F.col("level") == level)
        if latest.isEmpty():
            break
        # Folders without folders end here; those of very many are split.
        weighted = latest.select("folder_id", "visit").join(weights, "folder_id")
        found = lookup(edges, weighted, ["folder_id"], "_n", F.col("id"), hot_rows, held["folders"])
        found = found.filter("visit IS NOT NULL")
        frontier = found.select(F.col("id").alias("folder_id"), F.concat("visit", F.array(-F.col("position"))).alias("visit"))
    found = lookup_unweighted(
        children, opened.select("folder_id", "visit"), ["folder_id"], F.col("id"), hot_rows, held["items"])
    return found.filter("visit IS NOT NULL")


def walk(items: DataFrame, export_format: str = "office", hot_rows: int = HOT_ROWS,
         children: DataFrame | None = None) -> DataFrame:
    """Catalog rows of a listing: one per downloadable file, the first time it is met.

    Folders, shortcuts and native types without an export are no files and claim no id. With
    `children`, the dumped contents of folders, shared folders are walked into. Both should be stored
    tables: they are read several times.
    """
    if children is not None:
        items = add_shared_children(items, children, hot_rows)
    export = rules.native_export(F.col("mime_type"), export_format)
    native = rules.is_native(F.col("mime_type"))
    shown = (F.col("mime_type") != rules.FOLDER_TYPE) & F.col("shortcut_target").isNull()
    files = items.filter(shown & (~native | export.isNotNull()))
    # What follows from the type is found where rows end, so that it is not shuffled.
    emitted = build_paths(first_seen(files, "id", ["source_ordinal", "position"]), items, hot_rows)
    emitted = emitted.withColumn("_export", export)
    extension = F.coalesce(F.col("_export.extension"), F.lit(""))
    return emitted.select(
        F.when((F.col("source_ordinal") < 1 << 20) & (F.col("position") < 1 << 42),
               F.col("source_ordinal").cast("bigint") * F.lit(1 << 42) + F.col("position")).otherwise(
            F.raise_error(F.lit("the listing is too long for its rows to be numbered"))).alias("ordinal"),
        F.col("id").alias("file_id"),
        F.coalesce(F.col("name"), F.col("id")).alias("name"),
        F.concat("rel_path", extension).alias("rel_path"),
        "mime_type",
        F.coalesce(F.col("size").try_cast("bigint"), F.lit(0)).alias("size"),
        "drive_id",
        "drive_name",
        F.coalesce(F.get("owners", F.lit(0)), F.lit("")).alias("owner"),
        F.coalesce("modified_time", F.lit("")).alias("modified_time"),
        native.alias("is_native"),
        F.coalesce(F.col("_export.mime"), F.lit("")).alias("exported_as"),
    )


def add_shared_children(items: DataFrame, children: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Listing items plus what lies below the folders of the shared source, minus what it lists itself.

    The additions follow the source's own rows, in the order their folders are opened. They alone are written.
    """
    shared = items.filter("shared_with_me")
    extra = expand_folders(shared, children, hot_rows)
    fresh = numbered(extra.join(shared.select("id").distinct(), "id", "left_anti"), ["visit", "position"], "_n")
    source = shared.agg(
        F.max("position").alias("_last"),
        *[F.first(c).alias(c) for c in ("source_ordinal", "drive_id", "drive_name", "shared_with_me")],
    ).first()
    if source["_last"] is None:
        return items
    added = fresh.withColumn("position", F.lit(source["_last"]) + 1 + F.col("_n"))
    for name in ("source_ordinal", "drive_id", "drive_name", "shared_with_me"):
        added = added.withColumn(name, F.lit(source[name]))
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in items.schema.fields]
    return items.unionByName(cut_lineage(added.select(*typed)))
