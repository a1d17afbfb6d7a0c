"""Collision-free names on case-insensitive file systems, without a sequential pass."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from filecensus.functions import text
from filecensus.operators.scale import (
    CHUNK_ROWS, HOT_ROWS, cut_lineage, cut_lineage_counted, lookup, lookup_unweighted, ordinal_chunk, ranked,
    running_totals)

_GROUP = ["_base", "_tag"]


def unique_paths(rows: DataFrame, path: str, tag: str, taken: DataFrame | None = None, name: str = "unique_path",
                 hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Give every row, in `ordinal` order, the first name of its candidate list that is still free.

    `taken` is a one-column table of paths in use. Rows choosing in a fixed order is the case of
    stable matching in which every name prefers the smallest ordinal, so all rows propose at once:

    * Rows with equal path and tag share one candidate list, and the r-th of them by ordinal takes
      the r-th name of the list that is not blocked for the group. Any number of equal names thus
      spreads over different candidates before the first round.
    * A round finds the names that rows of several groups propose. The smallest ordinal holds such a
      name; for the losing group it becomes blocked, and the whole group moves up at once.
    * A block whose holder has gone, or comes after the first row that passed over the name, is
      lifted again.

    When no row loses and no block is lifted, each row holds a name of its own and every name it
    passed over is held by an earlier row or taken: exactly what choosing one by one gives.

    The first round's names are written once. Later rounds work through a list of dirty groups, those
    whose blocks have changed: only rows of groups that ever were dirty propose anew, and only the names
    they propose are looked up among those held, so what a round writes grows with the contested
    groups, not with the table.
    """
    used = blocks = None
    if taken is not None:
        used = cut_lineage(taken.select(text.fold_case(F.col(taken.columns[0])).alias("_key")).distinct())
    keyed = rows.withColumn("_base", text.fold_case(F.col(path))).withColumn("_tag", text.fold_case(F.col(tag)))
    keyed = cut_lineage(keyed)
    state, seen = cut_lineage_counted(_place(keyed, used, hot_rows, chunk_rows), n=F.count(F.lit(1)))
    count = seen["n"]
    if used is not None:
        blocks = _blocks_of_taken(used, state, hot_rows)
        blocks = None if blocks.isEmpty() else blocks
    base = cut_lineage(_propose(state, blocks, path, tag, name, hot_rows, chunk_rows, count))
    rest, touched, overlay = base, None, None
    # Proposals that may have lost, and all that hold a name.
    suspects, held = base, base
    while True:
        wanted = suspects.select("_key", "ordinal")
        if used is not None:
            wanted = wanted.unionByName(used.withColumn("ordinal", F.lit(-1).cast("bigint")))
        lost = _lost(suspects, wanted)
        lifted = None
        if blocks is not None:
            claims = held.select("_key", "ordinal")
            if used is not None:
                claims = claims.unionByName(used.withColumn("ordinal", F.lit(-1).cast("bigint")))
            lifted = cut_lineage(_unjustified(blocks, state, claims, chunk_rows))
            lifted = None if lifted.isEmpty() else lifted
        if lost is None and lifted is None:
            return held.select(*rows.columns, name)
        dirty = [found.select(*_GROUP) for found in (lost, lifted, touched) if found is not None]
        if lifted is not None:
            blocks = blocks.join(lifted, [*_GROUP, "_index"], "left_anti")
        if lost is not None:
            blocks = lost if blocks is None else blocks.unionByName(lost)
        blocks = cut_lineage(blocks.dropDuplicates([*_GROUP, "_index"]))
        touched = cut_lineage(functools.reduce(DataFrame.union, dirty).distinct())
        overlay = cut_lineage(_propose(
            _of_groups(state, touched, True, hot_rows, count), blocks, path, tag, name, hot_rows, chunk_rows, count))
        rest = _of_groups(base, touched, False, hot_rows, count)
        held = overlay.unionByName(rest)
        # Names of the others were settled before: only those that are proposed now can be contested.
        suspects = cut_lineage(overlay.unionByName(rest.join(overlay.select("_key").distinct(), "_key", "left_semi")))


def _of_groups(rows: DataFrame, groups: DataFrame, inside: bool, hot_rows: int, count: int) -> DataFrame:
    """The rows whose group is among these, or the others."""
    flagged = lookup_unweighted(rows, groups.withColumn("_inside", F.lit(True)), _GROUP, F.col("ordinal"), hot_rows, count)
    return flagged.filter("_inside" if inside else "_inside IS NULL").drop("_inside")


def _lost(proposals, claims):
    """Names that rows propose although an earlier claim holds them; None when there are none."""
    held = claims.groupBy("_key").agg(F.min("ordinal").alias("_holder"), F.count(F.lit(1)).alias("_claims"))
    contested = cut_lineage(held.filter("_claims > 1").drop("_claims"))
    if contested.isEmpty():
        return None
    lost = proposals.join(contested, "_key").filter("ordinal > _holder")
    return cut_lineage(lost.select(*_GROUP, "_start", "_index", "_key"))


def _place(keyed, used, hot_rows, chunk_rows):
    """Rank of every row within its group, and the first index the group may use.

    The plain path is index 0. Only the group of the path's first row may try it, and only if it is
    not taken.
    """
    bases = keyed.groupBy("_base").agg(F.count(F.lit(1)).alias("_n"), F.min("ordinal").alias("_first"))
    if used is not None:
        plain = used.select(F.col("_key").alias("_base"), F.lit(True).alias("_used"))
        free = F.when(F.col("_used").isNull(), F.col("_first"))
        bases = bases.join(plain, "_base", "left").select("_base", "_n", free.alias("_first"))
    placed = lookup(keyed, bases, ["_base"], "_n", F.col("ordinal"), hot_rows)
    numbered = ranked(placed.drop("_n"), _GROUP, ["ordinal"], ordinal_chunk("ordinal", chunk_rows), "_rank", "_lead")
    start = F.when(F.col("_lead") == F.col("_first"), 0).otherwise(1).cast("bigint")
    return numbered.withColumn("_start", start).drop("_lead", "_first")


def _blocks_of_taken(used, state, hot_rows):
    """Blocks that taken names such as `stem__tag.ext` or `stem__tag_n.ext` put on existing groups.

    Reading them off the names only saves rounds: a taken name that is not recognised here is met
    as an ordinary claim.
    """
    groups = state.select(*_GROUP, "_start").distinct()
    file = text.base_name(F.col("_key"))
    body = F.regexp_extract(text.stem(file), r"(?s)\A(.*)__(.+)\z", 1)
    rest = F.regexp_extract(text.stem(file), r"(?s)\A(.*)__(.+)\z", 2)
    counter = F.regexp_extract(rest, r"_([1-9][0-9]{0,14})\z", 1)
    plain = F.struct(rest.alias("_tag"), F.lit(1).cast("bigint").alias("_index"))
    counted = F.struct(
        F.left(rest, F.length(rest) - F.length(counter) - 1).alias("_tag"),
        (counter.try_cast("bigint") + 1).alias("_index"))
    readings = F.when(counter != "", F.array(plain, counted)).otherwise(F.array(plain))
    read = used.filter(rest != "").select(
        "_key", F.concat(text.parent(F.col("_key")), body, text.suffix(file)).alias("_base"), F.inline(readings))
    # Copies of one file may have left a long run of names for one group.
    matched = lookup_unweighted(read, groups, _GROUP, F.col("_key"), hot_rows)
    return cut_lineage(matched.filter("_start IS NOT NULL").select(*_GROUP, "_start", "_index", "_key"))


def _free_before(blocks, chunk_rows):
    """For every block the number of free names its group has before it."""
    numbered = ranked(blocks, _GROUP, ["_index"], F.floor(F.col("_index") / chunk_rows).cast("bigint"), "_nth")
    return numbered.withColumn("_before", F.col("_index") - F.col("_start") - F.col("_nth"))


def _propose(state, blocks, path, tag, name, hot_rows, chunk_rows, count):
    """Every row's current name: the free name of its group at the row's rank."""
    if blocks is None:
        indexed = state.withColumn("_index", F.col("_start") + F.col("_rank"))
    else:
        held = blocks.select(*_GROUP).distinct().withColumn("_held", F.lit(True))
        flagged = lookup_unweighted(state, held, _GROUP, F.col("ordinal"), hot_rows, count)
        steps = (
            _free_before(blocks, chunk_rows)
            .groupBy(*_GROUP, F.col("_before").alias("_rank"))
            .agg(F.count(F.lit(1)).alias("_skip"))
            .withColumn("_is_row", F.lit(0))
        )
        affected = flagged.filter("_held").drop("_held").withColumn("_is_row", F.lit(1))
        merged = affected.unionByName(steps, allowMissingColumns=True)
        skipped = running_totals(
            merged, _GROUP, ["_rank", "_is_row"], F.floor(F.col("_rank") / chunk_rows).cast("bigint"),
            {"_skipped": F.coalesce(F.col("_skip"), F.lit(0))})
        moved = skipped.filter("_is_row = 1").withColumn(
            "_index", F.col("_start") + F.col("_rank") + F.col("_skipped"))
        untouched = flagged.filter("_held IS NULL").drop("_held").withColumn(
            "_index", F.col("_start") + F.col("_rank"))
        indexed = untouched.unionByName(moved.select(*untouched.columns))
    candidate = text.candidate_path(F.col(path), F.col(tag), F.col("_index"))
    return indexed.withColumn(name, candidate).withColumn("_key", text.fold_case(F.col(name)))


def _unjustified(blocks, state, claims, chunk_rows):
    """Blocks passed over by a row that comes before every holder of the name."""
    placed = _free_before(blocks, chunk_rows).select(*_GROUP, "_index", "_key", F.col("_before").alias("_rank"))
    passed = placed.join(state.select(*_GROUP, "_rank", F.col("ordinal").alias("_passer")), [*_GROUP, "_rank"])
    holders = claims.join(passed.select("_key").distinct(), "_key", "left_semi")
    holders = holders.groupBy("_key").agg(F.min("ordinal").alias("_holder"))
    unheld = F.col("_holder").isNull() | (F.col("_passer") < F.col("_holder"))
    return passed.join(holders, "_key", "left").filter(unheld).select(*_GROUP, "_index")
