"""Near duplicates: greedy groups of vectors whose cosine reaches a threshold."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from filecensus.operators.scale import HOT_ROWS, cut_lineage, drop, lookup, new_table
from filecensus.sources import trees

# Fixed value: default threshold.
THRESHOLD = 0.95
# Vectors in a cell that are compared by one task, on either side.
BLOCK = 2048
# Vectors at home in a cell; one with more is split around about so many pivots, if that saves enough of its work.
ROWS_A_CELL = 16_384
PIVOTS = 32
# Rows that a task deals at a time.
DEALT = 4096
WORTHWHILE = 0.7
# Earliest shares of a crowded cell's rows that a round may look at.
_SHARES = [4.0 ** -k for k in range(16)]
_LAST = (1 << 63) - 1
# Products of a row and an anchor that a task looks at at a time.
_PRODUCTS = 1 << 22


def embed_texts(files: DataFrame, embed, max_chars: int | None = None) -> DataFrame:
    """Add `embedding` from a caller's pandas UDF over `text`, or over its head of `max_chars`.

    The rows are written, so the model runs once per file whatever is done with them; rows it answers null for go.
    """
    text = F.col("text") if max_chars is None else F.left(F.col("text"), F.lit(max_chars))
    embedded = cut_lineage(files.withColumn("embedding", embed.asNondeterministic()(text)).drop("text"))
    return embedded.filter("embedding IS NOT NULL AND size(embedding) > 0")


def embed_parts(parts: DataFrame, embed, key: str = "ordinal") -> DataFrame:
    """`embed_texts` of files that come in parts (`part`, `text`): the answers for a file's parts are added up.

    The sum points where the mean does. Every other column is one value for each `key`.
    """
    others = [c for c in parts.columns if c not in (key, "part", "text")]
    answered = embed_texts(parts, embed)
    sums = answered.select(key, *others, F.posexplode("embedding").alias("at", "value")).groupBy(key, *others, "at").agg(
        F.sum("value").alias("value"))
    pooled = F.sort_array(F.collect_list(F.struct("at", "value")))
    return sums.groupBy(key, *others).agg(F.transform(pooled, lambda x: x["value"]).alias("embedding"))


def near_texts(candidates: DataFrame, root: str, embed, threshold: float = THRESHOLD, part_bytes: int = 1 << 20,
               rows_a_cell: int = ROWS_A_CELL) -> DataFrame:
    """Near-duplicate members among the text files below `root`: read in parts, embedded, pooled and grouped."""
    parts = trees.read_text_parts(candidates.select("ordinal", "rel_path", "size"), root, part_bytes)
    return near_members(embed_parts(parts, embed), threshold, rows_a_cell=rows_a_cell)


def near_members(vectors: DataFrame, threshold: float = THRESHOLD, hot_rows: int = HOT_ROWS,
                 block: int = BLOCK, rows_a_cell: int = ROWS_A_CELL) -> DataFrame:
    """Every row that repeats an earlier one: its anchor and their similarity.

    `vectors` has ordinal, rel_path, size and embedding. In ordinal order a row joins the first
    anchor it is close enough to, or becomes an anchor.

    Equal vectors have equal neighbours, so they are first merged into one row that stands at their
    smallest ordinal; copies cost nothing however many there are. The others are dealt into cells
    (`_cells`), each of about `rows_a_cell` rows at home, which other rows visit if a row close to
    them can be at home there. A row is compared with the rows of its home cell.

    A cell that neither has guests nor sends any is settled by one task, row by row. For the others
    rounds settle rows in parallel: a row close to an anchor is a repeat, and a row that no open
    earlier row is close to is an anchor. A chain of rows each waiting for the one before it sets
    the number of rounds, not the number of rows. In a cell that is crowded because its rows are too
    close to be parted, a round looks at the earliest rows only and then at the anchors among them,
    so a crowd of near copies costs a pass, not a table of its pairs. Settled rows leave the rounds;
    only two counts of each round reach the driver.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and not above 1")
    numbers = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    usable = vectors.filter("size(embedding) > 0").withColumn("embedding", numbers)
    usable = usable.filter(F.exists("embedding", lambda x: x != 0)).withColumns({
        "_k1": F.xxhash64("embedding"), "_k2": F.xxhash64(F.lit(1), "embedding")})
    usable = cut_lineage(usable)
    classes = usable.groupBy("_k1", "_k2").agg(F.min("ordinal").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = cut_lineage(classes.join(
        usable.select(F.col("ordinal").alias("head"), F.col("rel_path").alias("path"), "embedding"), "head"))
    followed = _follow(heads, threshold, block, rows_a_cell)
    facts = heads.select("_k1", "_k2", "head", "n", F.col("path").alias("_path")).join(followed, "head", "left").join(
        heads.select(F.col("head").alias("anchor"), F.col("path").alias("_other_path")), "anchor", "left")
    facts = facts.select(
        "_k1", "_k2", "head", "n", F.coalesce("anchor", "head").alias("anchor"),
        F.coalesce("_other_path", "_path").alias("anchor_path"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    rows = lookup(usable, facts, ["_k1", "_k2"], "n", F.col("ordinal"), hot_rows)
    return rows.filter("ordinal <> anchor").select(
        "ordinal", "rel_path", "size", "anchor", "anchor_path", "similarity")


def near_duplicates(members: DataFrame) -> DataFrame:
    """Groups of `near_members`: kind, key, primary, number of copies and the bytes they hold."""
    return members.groupBy("anchor", "anchor_path").agg(
        F.count(F.lit(1)).alias("n_duplicates"), F.sum("size").alias("reclaimable_bytes")
    ).select(
        F.lit("near").alias("kind"), F.col("anchor_path").alias("key"), F.col("anchor_path").alias("primary"),
        "n_duplicates", "reclaimable_bytes")


def _units(lists: pa.Array) -> np.ndarray:
    rows = lists.flatten().to_numpy().reshape(len(lists), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


_VISIT = "width int, cell bigint, home boolean, head bigint, embedding array<double>"
_CELL = ["width", "cell"]


def _cells(heads: DataFrame, threshold: float, rows_a_cell: int) -> DataFrame:
    """Every row (head, embedding) once at home in a cell, and as a guest wherever a neighbour may live.

    Cells are balls. One with too many rows at home is split around pivots of its own: each of its
    rows, guests too, is at home with (or, as a guest, nearest to) one of them. On the unit sphere a
    cosine of t is an angle of arccos t, so by the triangle inequality a row with a neighbour at home
    around a pivot is no further from it than twice that angle beyond its own nearest pivot, nor than
    that angle beyond the cell's radius. Rows go level by level; pivots are told only to the tasks of
    their cell, in chunks of rows, so neither a table of all pivots nor a whole cell is in one place.
    """
    reach = math.acos(min(threshold, 1.0)) + 1e-6  # rounding must not lose a neighbour
    live = heads.select(F.size("embedding").alias("width"), F.lit(0).cast("bigint").alias("cell"), F.lit(True).alias("home"),
                        "head", "embedding")
    chunk = min(rows_a_cell, DEALT)
    leaves = []
    for level in itertools.count():
        sizes = _sizes(live)
        if not sizes.filter(F.col("at_home") > rows_a_cell).limit(1).count():
            return functools.reduce(DataFrame.union, [*leaves, live])
        sizes = cut_lineage(sizes)
        rows = lookup(live, sizes, _CELL, "n", F.col("head"), rows_a_cell)
        counts = ["n", "at_home", "work"]
        leaves.append(rows.filter(F.col("at_home") <= rows_a_cell).drop(*counts))
        crowded = cut_lineage(rows.filter(F.col("at_home") > rows_a_cell))
        pivots = cut_lineage(_pivots(crowded, level))
        radii = _dealt(crowded, pivots.withColumn("radius", F.lit(math.inf)), reach, chunk, _radii).groupBy(
            "width", "cell", "head").agg(F.max("radius").alias("radius"))
        pivots = cut_lineage(pivots.join(radii, ["width", "cell", "head"], "left"))
        # A split that leaves most of the work is left alone: the rows are too close to be parted. Only counts are
        # written to find out.
        after = _dealt(crowded, pivots, reach, chunk, _counts).groupBy("width", "cell", "child").agg(
            F.sum("n").alias("n"), F.sum("at_home").alias("at_home")).groupBy("width", "cell").agg(
            F.sum(F.col("n").cast("double") * F.col("at_home")).alias("left"))
        worth = cut_lineage(sizes.join(after, _CELL).select(
            *_CELL, "n", (F.col("left") <= WORTHWHILE * F.col("work")).alias("split")))
        judged = lookup(crowded, worth.withColumnRenamed("n", "_n"), _CELL, "_n", F.col("head"), rows_a_cell).drop("_n")
        leaves.append(judged.filter("NOT split").drop(*counts, "split"))
        split = worth.filter("split").select(*_CELL)
        live = cut_lineage(_dealt(judged.filter("split").drop("split"), pivots.join(split, _CELL), reach, chunk, _visits))


def _sizes(visits: DataFrame) -> DataFrame:
    """Rows of each cell, those at home, and how many pairs it compares."""
    return visits.groupBy(*_CELL).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("home").alias("at_home")).withColumn(
        "work", F.col("n").cast("double") * F.col("at_home"))


def _pivots(rows: DataFrame, level: int) -> DataFrame:
    drawn = F.pmod(F.xxhash64("head", F.lit(level)), F.lit(1 << 40)) * F.col("at_home") < PIVOTS * (1 << 40)
    return rows.filter(F.col("home") & drawn).select(*_CELL, "head", "embedding", "n")


def _dealt(rows: DataFrame, pivots: DataFrame, reach: float, chunk: int, told) -> DataFrame:
    """What `told` says about the rows of crowded cells in the cells around their pivots, chunk by chunk.

    `radius` is how far the rows at home around a pivot are from it, infinite as long as it is not known.
    """
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    centres = pivots.select(*_CELL, F.lit(True).alias("pivot"), F.lit(True).alias("home"), "head", "embedding", "radius",
                            F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    others = rows.select(*_CELL, F.lit(False).alias("pivot"), "home", "head", "embedding",
                         F.lit(0.0).alias("radius"), F.pmod(F.xxhash64("head"), chunks).cast("int").alias("chunk"))

    def deal(key: tuple, table: pa.Table) -> pa.Table:
        mine = table.filter(pc.equal(table["pivot"], False)).combine_chunks()
        pivots = table.filter(table["pivot"]).sort_by("head").combine_chunks()
        rows = np.arange(mine.num_rows)
        if not mine.num_rows or not pivots.num_rows:
            angles, radii, names = np.zeros((mine.num_rows, 1)), np.array([math.inf]), [key[1].as_py()]
        else:
            angles = np.arccos(np.clip(_units(mine["embedding"].combine_chunks()) @ _units(
                pivots["embedding"].combine_chunks()).T, -1, 1))
            radii = pivots["radius"].to_numpy()
            names = [_cell_name(key[1].as_py(), head) for head in pivots["head"].to_pylist()]
        nearest = angles.argmin(axis=1)
        kept = (angles <= angles[rows, nearest][:, None] + 2 * reach) & (angles <= radii[None] + reach)
        at, child = np.nonzero(kept)
        home = mine["home"].to_numpy(zero_copy_only=False)[at] & (child == nearest[at])
        return told(key, mine, pivots, np.array(names, dtype=np.int64), at, child, home, angles)

    return centres.unionByName(others).groupBy(*_CELL, "chunk").applyInArrow(deal, told.schema)


def _radii(key, mine, pivots, names, at, child, home, angles) -> pa.Table:
    radii = np.full(len(names), -1.0)
    np.maximum.at(radii, child[home], angles[at[home], child[home]])
    told = np.flatnonzero(radii >= 0) if pivots.num_rows else np.empty(0, dtype=np.int64)
    return pa.table({"width": pa.array([key[0].as_py()] * len(told), pa.int32()),
                     "cell": pa.array([key[1].as_py()] * len(told), pa.int64()),
                     "head": pivots["head"].take(pa.array(told)), "radius": radii[told]})


_radii.schema = "width int, cell bigint, head bigint, radius double"


def _counts(key, mine, pivots, names, at, child, home, angles) -> pa.Table:
    return pa.table({"width": pa.array([key[0].as_py()] * len(names), pa.int32()),
                     "cell": pa.array([key[1].as_py()] * len(names), pa.int64()), "child": names,
                     "n": np.bincount(child, minlength=len(names)).astype(np.int64),
                     "at_home": np.bincount(child[home], minlength=len(names)).astype(np.int64)})


_counts.schema = "width int, cell bigint, child bigint, n bigint, at_home bigint"


def _visits(key, mine, pivots, names, at, child, home, angles) -> pa.Table:
    taken = mine.take(pa.array(at))
    return pa.table({"width": taken["width"], "cell": names[child], "home": home, "head": taken["head"],
                     "embedding": taken["embedding"]})


_visits.schema = _VISIT


def _cell_name(parent: int, pivot: int) -> int:
    """Cells that happen to get one name are one cell; that costs time, not rows."""
    digest = hashlib.blake2b(b"%d %d" % (parent, pivot), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _tiles(cells: DataFrame, block: int) -> DataFrame:
    """Blocks of rows at home (side 0) against blocks of all rows of the cell they may have to do with (side 1)."""
    sizes = cells.groupBy(*_CELL).agg(
        F.count(F.lit(1)).alias("n"), F.ceil(F.count_if("home") / block).cast("int").alias("homes"),
        F.ceil(F.count_if("asked") / block).cast("int").alias("others")).filter("homes > 0 AND others > 0")
    placed = lookup(cells, sizes, _CELL, "n", F.col("head"), block * block).filter("homes IS NOT NULL")
    place = F.xxhash64("head")
    as_home = placed.filter("home").withColumns({
        "i": F.pmod(place, "homes").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("others") - 1)), "side": F.lit(0)})
    as_other = placed.filter("asked").withColumns({
        "i": F.explode(F.sequence(F.lit(0), F.col("homes") - 1)), "j": F.pmod(place, "others").cast("int"), "side": F.lit(1)})
    return as_home.unionByName(as_other).drop("n", "homes", "others", "home", "asked")


def _compared(cells: DataFrame, block: int, judge, schema: str) -> DataFrame:
    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, others = (table.filter(pc.equal(table["side"], side)) for side in (0, 1))
        if not own.num_rows or not others.num_rows:
            return pa.table({name: pa.array([], type) for name, type in judge.columns})
        close = _units(own["embedding"].combine_chunks()) @ _units(others["embedding"].combine_chunks()).T
        before = others["head"].to_numpy()[None, :] < own["head"].to_numpy()[:, None]
        return judge(own, others, close, before)

    return _tiles(cells, block).groupBy(*_CELL, "i", "j").applyInArrow(tile, schema)


_FOLLOWED = "head bigint, anchor bigint, similarity double"


def _settled_alone(cells: DataFrame, limit: float, block: int) -> DataFrame:
    """The rule itself, for cells of bounded size that have to do with no other: one task follows each."""
    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by("head").combine_chunks()
        heads, units = table["head"].to_numpy(), _units(table["embedding"].combine_chunks())
        anchors = np.empty(0, dtype=np.int64)
        first, similarity = np.full(len(heads), -1), np.zeros(len(heads))
        for begin in range(0, len(heads), block):
            some = units[begin:begin + block]
            if len(anchors):
                close = some @ units[anchors].T
                near = close >= limit
                at = near.argmax(axis=1)
                found = np.flatnonzero(near[np.arange(len(some)), at])
                first[begin + found], similarity[begin + found] = anchors[at[found]], close[found, at[found]]
            left = np.flatnonzero(first[begin:begin + len(some)] < 0)
            close = some[left] @ some[left].T
            fresh = []
            for i in range(len(left)):
                near = [j for j in fresh if close[i, j] >= limit] if len(fresh) < 8 else np.array(fresh)[close[i, fresh] >= limit]
                if len(near):
                    first[begin + left[i]], similarity[begin + left[i]] = begin + left[near[0]], close[i, near[0]]
                else:
                    fresh.append(i)
            anchors = np.concatenate([anchors, begin + left[fresh]]).astype(np.int64)
        found = first >= 0
        return pa.table({"head": heads[found], "anchor": heads[first[found]], "similarity": np.minimum(similarity[found], 1.0)})

    return cells.groupBy(*_CELL).applyInArrow(follow, _FOLLOWED)


def _follow(heads: DataFrame, threshold: float, block: int, rows_a_cell: int) -> DataFrame:
    """(head, anchor, similarity) of every row that repeats an earlier one."""
    # Products of unit vectors may miss a threshold of 1 by rounding.
    limit = threshold - 1e-9 if threshold == 1 else threshold
    early, heads = _early(heads, limit, block, rows_a_cell)
    return functools.reduce(DataFrame.union, [*early, _follow_cells(heads, threshold, limit, block, rows_a_cell)])


def _early(heads: DataFrame, limit: float, block: int, rows_a_cell: int) -> tuple[list[DataFrame], DataFrame]:
    """Follow the rule for the earliest rows first, and for all later rows as far as the anchors among them go.

    A task settles the earliest `rows_a_cell` rows (of each width), then the others are compared with their anchors, chunk
    by chunk; those that none is close to are left, and the rule goes on among them as if there were no others. This
    is repeated while it pays: where anchors claim a good part of what comes after them, the work is rows times anchors,
    whatever the cells would be worth. What is left is returned besides what was found.
    """
    found = []
    rest = heads.select(F.size("embedding").alias("width"), F.lit(0).cast("bigint").alias("cell"), "head", "embedding")
    n = rest.count()
    while n > rows_a_cell:
        cut = rest.select(F.percentile_approx("head", rows_a_cell / n, max(10_000, 10 * n // rows_a_cell))).first()[0]
        first = cut_lineage(rest.filter(F.col("head") <= cut))
        repeats = cut_lineage(_settled_alone(first, limit, block))
        anchors = first.join(repeats.select("head"), "head", "left_anti")
        later = rest.filter(F.col("head") > cut)
        claims = cut_lineage(_claimed(later, anchors, n, limit, rows_a_cell))
        left, seen = claims.agg(F.count_if(F.col("anchor").isNull()), F.count(F.lit(1))).first()
        found += [repeats, claims.filter("anchor IS NOT NULL").select("head", "anchor", "similarity")]
        rest = claims.filter("anchor IS NULL").select("width", F.lit(0).cast("bigint").alias("cell"), "head", "embedding")
        n = left
        if left > WORTHWHILE * seen:
            break
    return found, rest.select("head", "embedding")


_CLAIMS = "width int, head bigint, embedding array<double>, anchor bigint, similarity double"


def _claimed(rows: DataFrame, anchors: DataFrame, n: int, limit: float, chunk: int) -> DataFrame:
    """Rows with the first of the anchors that is close to them; those without one keep their vectors."""
    chunks = -(-n // chunk)
    claiming = anchors.select("width", "head", "embedding", F.lit(True).alias("claims"),
                              F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    others = rows.select("width", "head", "embedding", F.lit(False).alias("claims"),
                         F.pmod(F.xxhash64("head"), F.lit(chunks)).cast("int").alias("chunk"))

    def claim(table: pa.Table) -> pa.Table:
        mine = table.filter(pc.invert(table["claims"])).combine_chunks()
        anchors = table.filter(table["claims"]).sort_by("head").combine_chunks()
        anchor, similarity = np.zeros(mine.num_rows, dtype=np.int64), np.zeros(mine.num_rows)
        found = np.zeros(mine.num_rows, dtype=bool)
        if mine.num_rows and anchors.num_rows:
            units, targets = _units(mine["embedding"].combine_chunks()), _units(anchors["embedding"].combine_chunks())
            names = anchors["head"].to_numpy()
            step = max(1, _PRODUCTS // len(targets))
            for begin in range(0, len(units), step):
                close = units[begin:begin + step] @ targets.T
                near = close >= limit
                at = near.argmax(axis=1)
                some = np.arange(len(at))
                found[begin:begin + step], anchor[begin:begin + step] = near[some, at], names[at]
                similarity[begin:begin + step] = np.minimum(close[some, at], 1.0)
        vectors = pc.if_else(pa.array(found), pa.scalar(None, table.schema.field("embedding").type), mine["embedding"])
        return pa.table({"width": mine["width"], "head": mine["head"], "embedding": vectors,
                         "anchor": pa.array(anchor, mask=~found), "similarity": pa.array(similarity, mask=~found)})

    return claiming.unionByName(others).groupBy("width", "chunk").applyInArrow(claim, _CLAIMS)


def _follow_cells(heads: DataFrame, threshold: float, limit: float, block: int, rows_a_cell: int) -> DataFrame:
    """The rule for rows that the earliest ones have not settled, cell by cell."""
    cells = cut_lineage(_cells(heads, threshold, rows_a_cell))
    roaming = cells.groupBy("head").agg(F.count(F.lit(1)).alias("visits")).filter("visits > 1").withColumn("visits", F.lit(True))
    tied = cells.select(*_CELL, "head").join(roaming, "head", "left").groupBy(*_CELL).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("visits"), F.lit(False)).alias("tied"))
    facts = cut_lineage(tied.withColumn("alone", ~F.col("tied") & (F.col("n") <= rows_a_cell)).drop("tied"))
    sorted_ = lookup(cells, facts, _CELL, "n", F.col("head"), rows_a_cell).drop("n")
    alone = _settled_alone(sorted_.filter("alone").drop("alone"), limit, block)
    if not facts.filter("NOT alone").limit(1).count():
        return cut_lineage(alone)
    rest = cut_lineage(sorted_.filter("NOT alone").drop("alone"))
    return cut_lineage(alone).union(_rounds(rest, limit, block, rows_a_cell))


def _rounds(cells: DataFrame, limit: float, block: int, rows_a_cell: int) -> DataFrame:
    spark = cells.sparkSession

    def settle(own, others, close, before):
        near = (close >= limit) & before
        anchors = others["anchor"].to_numpy(zero_copy_only=False)
        return pa.table({"head": own["head"], "repeat": (near & anchors[None]).any(axis=1),
                         "waits": (near & ~anchors[None]).any(axis=1) | own["late"].to_numpy(zero_copy_only=False)})

    settle.columns = [("head", pa.int64()), ("repeat", pa.bool_()), ("waits", pa.bool_())]
    state = cut_lineage(cells.filter("home").select("head", F.lit(False).alias("anchor")))
    anchors, folders = [], []
    while True:
        # Open rows, and the anchors found last, which claim what is close to them.
        live = cells.join(state, "head")
        # The earliest rows of a crowded cell; a later one is no anchor before all of them are settled.
        crowd = live.groupBy(*_CELL).agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("head", _SHARES).alias("cuts"))
        share = F.least(F.lit(len(_SHARES)), F.ceil(F.log(4.0, F.col("n") / rows_a_cell)) + 2).cast("int")
        cut = F.when(F.col("n") <= rows_a_cell, _LAST).otherwise(F.element_at("cuts", share))
        live = lookup(live, crowd.select(*_CELL, "n", cut.alias("cut")), _CELL, "n", F.col("head"), block * block)
        late = ~F.col("anchor") & (F.col("head") > F.col("cut"))
        live = live.select(*_CELL, "head", "embedding", "anchor", (F.col("home") & ~F.col("anchor")).alias("home"),
                           (~late).alias("asked"), late.alias("late"))
        judged = _compared(live, block, settle, "head bigint, repeat boolean, waits boolean")
        told = judged.groupBy("head").agg(F.max("repeat").alias("repeat"), F.max("waits").alias("waits"))
        told = state.filter("NOT anchor").join(told, "head", "left").filter("NOT coalesce(repeat, false)").select(
            "head", (~F.coalesce("waits", F.lit(False))).alias("anchor"))
        folder = new_table(spark)
        told.write.parquet(folder)
        folders.append(folder)
        state = spark.read.parquet(folder)
        fresh, left = state.agg(F.count_if("anchor"), F.count(F.lit(1))).first()
        if not left:
            break
        anchors.append(state.filter("anchor").select("head"))
    if not anchors:
        return spark.createDataFrame([], _FOLLOWED)
    chosen = cut_lineage(functools.reduce(DataFrame.union, anchors).select("head", F.lit(True).alias("anchor")))
    for folder in folders:
        drop(spark, folder)
    marked = cells.join(chosen, "head", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    # Repeats at home are compared with anchors of the cell.
    marked = marked.withColumns({"home": F.col("home") & ~F.col("anchor"), "asked": F.col("anchor")}).filter("home OR asked")

    def first(own, others, close, before):
        near = (close >= limit) & before
        names = np.where(near, others["head"].to_numpy()[None], np.iinfo(np.int64).max)
        at = names.argmin(axis=1)
        rows = np.arange(len(at))
        found = near[rows, at]
        return pa.table({"head": own["head"].to_numpy()[found], "anchor": names[rows, at][found],
                         "similarity": np.minimum(close[rows, at][found], 1.0)})

    first.columns = [("head", pa.int64()), ("anchor", pa.int64()), ("similarity", pa.float64())]
    claims = _compared(marked, block, first, _FOLLOWED)
    claims = cut_lineage(claims)
    least = claims.groupBy("head").agg(F.min("anchor").alias("anchor"))
    return claims.join(least, ["head", "anchor"])
