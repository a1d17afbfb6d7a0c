"""Near-duplicate vectors by a pivot-permutation index, verified by their cosine.

Each vector is described by its nearest reference points (pivots), in order. Vectors whose descriptions share enough
pivots are candidates. The inverted list of a pivot holds the vectors that it describes; as candidates share at
least SHARED of their NEAREST pivots, the smallest pivot that two of them share is among the first
NEAREST - SHARED + 1 of each, so only these are listed, and a pair is looked at only in the list of its smallest
shared pivot. Long lists are cut into blocks, and each pair of blocks is one task's matrix of shared-pivot counts
and cosines; no table of pairs is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from filecensus.llm.components import TILE, connected, tile_result
from filecensus.llm.joins import smallest
from filecensus.operators.scale import cut_lineage, cut_lineage_counted, lookup

THRESHOLD = 0.93
NEAREST = 8
SHARED = 3
# Vectors that the pivots are chosen from, and least and most pivots; between them, one for every ROWS_A_PIVOT rows.
SAMPLE = 8_192
PIVOTS = (64, 2_048)
ROWS_A_PIVOT = 256
BLOCK = 1_024


def _units(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width as unit vectors in double precision."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    # First by the largest component, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(sample: pa.Array, count: int) -> dict[int, np.ndarray]:
    """For each width, up to `count` vectors of the sample that lie far from each other, as unit vectors.

    Each next pivot is the vector whose largest cosine to the pivots before it is least.
    """
    widths = pc.list_value_length(sample).to_numpy(zero_copy_only=False)
    found = {}
    for width in np.unique(widths).tolist():
        units = np.unique(_units(sample.filter(pa.array(widths == width)), width), axis=0)
        chosen, nearest = [0], units @ units[0]
        while len(chosen) < min(count, len(units)):
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, units @ units[chosen[-1]])
        found[width] = units[chosen]
    return found


def describe(units: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    count = min(nearest, len(pivots))
    found = []
    for begin in range(0, len(units), 4096):
        cosines = units[begin:begin + 4096] @ pivots.T
        some = np.argpartition(-cosines, count - 1, axis=1)[:, :count]
        order = np.argsort(-np.take_along_axis(cosines, some, axis=1), axis=1, kind="stable")
        found.append(np.take_along_axis(some, order, axis=1))
    return np.concatenate(found) if found else np.zeros((0, count), dtype=np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit key of each vector; null where it can be linked with nothing."""
    for batch in batches:
        keys = []
        for label, row in zip(batch.column("label"), batch.column("embedding"), strict=True):
            values = row.values if row.is_valid else None
            if values is None or not label.is_valid or len(values) == 0 or values.null_count:
                keys.append(None)
                continue
            numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
            usable = np.isfinite(numbers).all() and numbers.any()
            keys.append(hashlib.blake2b(f"{label} ".encode() + numbers.tobytes(), digest_size=16).digest()
                        if usable else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())],
                                         names=[*batch.schema.names, "key"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int = SHARED,
                 pivots: tuple[int, int] = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vec_id, embedding and label.

    Vectors of equal label and width are linked if their cosine in double precision is at least `threshold` and the
    index finds them; equal vectors always are. Vectors that are null, empty, zero or hold null or non-finite
    components, and vectors without a label, are linked with nothing. n_links counts other rows; component_id is
    the smallest vec_id that links lead to, itself included; kept says that this is the row's own vec_id (false for
    a null vec_id, which is never the smallest). Other columns are not looked at.

    Pivots are chosen among SAMPLE vectors of smallest hash; the index holds every vector.
    """
    kinds = dict(vectors.dtypes)
    rows = vectors.select("vec_id", "embedding", "label", F.monotonically_increasing_id().alias("row"))
    rows = cut_lineage(rows.mapInArrow(
        _keys, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, label {kinds['label']}, row bigint, "
               "key binary"))
    classes = cut_lineage(rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")))
    heads = cut_lineage(rows.select("row", "label", "embedding").join(
        classes.select(F.col("node").alias("row"), "copies"), "row").withColumnRenamed("row", "node"))

    n = heads.count()
    sample = smallest(heads, F.col("node"), SAMPLE).select("embedding").toArrow()
    count = int(np.clip(n // ROWS_A_PIVOT, *pivots))
    points = choose_pivots(sample.column(0).combine_chunks(), count)
    first = nearest - shared + 1

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            widths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            own: list[list[int]] = [[] for _ in range(len(widths))]
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                if width in points:
                    found = describe(_units(lists.take(pa.array(at)), width), points[width], nearest)
                    for i, numbers in zip(at.tolist(), np.sort(found, axis=1).tolist(), strict=True):
                        own[i] = numbers
            # A width that the sample does not hold has one list for all its vectors.
            listed = [x[:max(1, first - (nearest - len(x)))] or [-1] for x in own]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(widths, pa.int32()), pa.array(own, pa.list_(pa.int32())),
                 pa.array(listed, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "width", "pivots", "listed"])

    postings = heads.mapInArrow(
        described, f"node bigint, label {kinds['label']}, embedding {kinds['embedding']}, copies bigint, width int, "
                   "pivots array<int>, listed array<int>").withColumn("pivot", F.explode("listed")).drop("listed")
    postings = cut_lineage(postings)
    lists = ["label", "width", "pivot"]
    sizes, seen = cut_lineage_counted(postings.groupBy(*lists).agg(F.count(F.lit(1)).alias("n")), heaviest=F.max("n"))
    cut = lookup(postings, sizes, lists, "n", F.col("node"), heaviest=seen["heaviest"] or 0).withColumn(
        "blocks", F.ceil(F.col("n") / block).cast("int")).drop("n").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({
        "i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with", "blocks")

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        return _tile(threshold, shared, *(x.as_py() for x in key[1:]), table)

    verified = cut_lineage(tiles.groupBy("label", "width", "pivot", "i", "j").applyInArrow(tile, TILE))
    linked = connected(verified.select(F.col("node").alias("a"), F.col("other").alias("b")))
    totals = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(linked, "node", "left").join(totals, "node", "left").select(
        "key", "copies", "least_id", F.coalesce("component", "node").alias("component"),
        F.coalesce("links", F.lit(0)).alias("links"))
    least = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known, seen = cut_lineage_counted(
        known.join(least, "component").select("key", "copies", "links", "component_id"), heaviest=F.max("copies"))
    alone = rows.filter("key IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    keyed = rows.filter("key IS NOT NULL").select("vec_id", "key", "row")
    found = lookup(keyed, known, ["key"], "copies", F.col("row"), heaviest=seen["heaviest"] or 0).select(
        "vec_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    return found.union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _tile(threshold: float, shared: int, width: int, pivot: int, i: int, j: int, table: pa.Table) -> pa.Table:
    """Find and verify the links between two blocks of a pivot's list."""
    table = table.combine_chunks()
    order = pc.sort_indices(table["node"])
    nodes, copies = table["node"].take(order).to_numpy(), table["copies"].take(order).to_numpy()
    block = table["block"].take(order).to_numpy()
    units = _units(table["embedding"].take(order).combine_chunks(), width)
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    wanted = units[a] @ units[b].T >= threshold
    if i == j:
        wanted &= a[:, None] < b[None]
    x, y = np.nonzero(wanted)
    if pivot >= 0 and len(x):
        own = table["pivots"].take(order).combine_chunks()
        lists = own.flatten().to_numpy().reshape(len(nodes), -1)
        keep = np.zeros(len(x), dtype=bool)
        for begin in range(0, len(x), 1 << 16):
            some = slice(begin, begin + (1 << 16))
            same = lists[a[x[some]]][:, :, None] == lists[b[y[some]]][:, None, :]
            common = np.where(same.any(axis=2), lists[a[x[some]]], np.iinfo(np.int32).max)
            keep[some] = (same.sum(axis=(1, 2)) >= min(shared, lists.shape[1])) & (common.min(axis=1) == pivot)
        x, y = x[keep], y[keep]
    return tile_result(nodes, copies, a[x], b[y])
