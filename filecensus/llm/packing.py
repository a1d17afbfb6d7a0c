"""Packing token pieces into sequences of bounded length by sums of squares.

A sequence that is not full has a gap. Each piece goes where it makes the sum, over all gaps, of the squared number
of sequences with that gap smallest: into a sequence whose gap is common, so that it becomes one of a rare gap, or
full. Pieces are taken from the longest to the shortest, and new sequences count as open, with the whole length as
their gap, as long as there are no more of them than the tokens need at the least; beyond that one is begun only
where nothing else fits. A second run begins a sequence only where nothing else fits, and the better run is taken.

Only lengths are packed; token ids stay where they were written. Pieces are dealt into groups of bounded size that
are packed side by side. What stands in sequences that did not get full is packed anew, over fewer groups in each
round, down to a single one; a group that gains nothing stays as it was.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filecensus.llm.token_files import tokenizer_of
from filecensus.llm.words import list_array, steps
from filecensus.operators.scale import cut_lineage

CAPACITY = 2048
# Pieces that one task packs at a time.
GROUP = 50_000

_PLACED = "row bigint, length bigint, sequence_id bigint, offset bigint, gap bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY,
               end_id: int = 0) -> DataFrame:
    """row (unique), doc_id, piece, start, length and ids of the pieces of all texts, as a written table.

    A document is the ids of its whole text with `end_id` behind; null and empty texts are that id alone. Longer ones
    than `capacity` are cut so that only the first piece is shorter. Null and repeated doc_ids stay documents of
    their own, other columns are not looked at.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_of(tokenizer, pattern)
        for batch in batches:
            begin = 0
            for texts in steps(batch.column(1)):
                values, counts = tokens.encode(texts, end_id)
                pieces = -(-counts // capacity)
                piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = np.repeat(counts - (pieces - 1) * capacity, pieces)
                lengths = np.where(piece == 0, head, capacity)
                starts = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                owner = np.repeat(np.arange(begin, begin + len(texts)), pieces)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)),
                     pa.array(starts.astype(np.int64)), pa.array(lengths.astype(np.int64)),
                     list_array([(values, lengths)])], names=["doc_id", "piece", "start", "length", "ids"])
                begin += len(texts)

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids array<int>")
    return cut_lineage(found.select(F.monotonically_increasing_id().alias("row"), "*"))


def sums_of_squares(lengths: list[int], capacity: int, free: int) -> tuple[list[int], int]:
    """The bin of each piece, in the given order, and the number of bins; `free` bins may be begun at any time."""
    open_bins = np.zeros(capacity + 1, dtype=np.int64)  # by gap
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, begun = [], 0
    for length in lengths:
        # Half the change of the sum when a bin of gap length + k becomes one of gap k.
        here = open_bins[length:capacity]
        change = open_bins[:capacity - length] - here + 1.0
        if len(change):
            change[0] = 0.5 - here[0]
            change[here == 0] = np.inf
            k = int(change.argmin())
        fits = len(change) > 0 and change[k] < np.inf
        fresh = open_bins[capacity - length] + 0.5 if length < capacity else 0.0
        if fits and (begun >= free or change[k] <= fresh):
            open_bins[length + k] -= 1
            one = members[length + k].pop()
        else:
            k, one, begun = capacity - length, begun, begun + 1
        if k:
            open_bins[k] += 1
            members[k].append(one)
        where.append(one)
    return where, begun


def _pack_group(capacity: int, table: pa.Table) -> pa.Table:
    """Places of the pieces of one group; as before where that takes no more sequences."""
    table = table.select(["row", "length", "sequence_id", "offset"]).sort_by([("length", "descending"), ("row", "ascending")])
    rows, lengths = table["row"].to_numpy(), table["length"].to_numpy()
    least = -(-int(lengths.sum()) // capacity)
    runs = [sums_of_squares(lengths.tolist(), capacity, free) for free in (least, 0)]
    where, bins = min(runs, key=lambda run: run[1])
    before = table["sequence_id"].combine_chunks()
    if before.null_count == 0 and len(before.unique()) <= bins:
        bin_of = np.unique(before.to_numpy(), return_inverse=True)[1]
        names, offsets = before.to_numpy(), table["offset"].to_numpy()
    else:
        bin_of = np.array(where, dtype=np.int64)
        first = np.unique(bin_of, return_index=True)[1]
        names = rows[first][bin_of]
        order = np.argsort(bin_of, kind="stable")
        sizes = lengths[order]
        ends = np.cumsum(sizes)
        begins = np.concatenate([[True], np.diff(bin_of[order]) > 0]) if len(order) else np.empty(0, dtype=bool)
        base = np.maximum.accumulate(np.where(begins, ends - sizes, 0))
        offsets = np.empty(len(order), dtype=np.int64)
        offsets[order] = ends - sizes - base
    gaps = capacity - np.bincount(bin_of, weights=lengths).astype(np.int64)[bin_of]
    return pa.table({"row": rows, "length": lengths, "sequence_id": names, "offset": offsets, "gap": gaps})


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """row, sequence_id and offset for `pieces` with columns row (unique, long) and length (1 to `capacity`).

    sequence_id is the row of the sequence's first piece in the round that made it; offsets are gapless from 0.
    Lengths that are equal are packed alike, an empty table gives an empty one.
    """
    lengths = pieces.select("row", F.col("length").cast("bigint"))
    done = lengths.filter(F.col("length") >= capacity).select(
        "row", F.col("row").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left = lengths.filter(F.col("length") < capacity).select(
        "*", F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset"))
    def pack_group(table: pa.Table) -> pa.Table:
        return _pack_group(capacity, table)

    count, settled = left.count(), [done]
    while count:
        groups = -(-count // group)
        # Sequences of earlier rounds stay together, so that a group can be left as it was.
        dealt = left.withColumn("deal", F.pmod(F.xxhash64(F.coalesce("sequence_id", "row"), F.lit(groups)), F.lit(groups)))
        packed = cut_lineage(dealt.groupBy("deal").applyInArrow(pack_group, _PLACED))
        left = packed.filter("gap > 0").drop("gap")
        before, count = count, left.count()
        if groups == 1 or 2 * count > before:
            # Packing the rest over again would find the same gaps.
            settled.append(packed.select("row", "sequence_id", "offset"))
            break
        settled.append(packed.filter("gap = 0").select("row", "sequence_id", "offset"))
    return functools.reduce(DataFrame.union, settled)


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY,
                   end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of the pieces of all documents; see `cut_pieces`."""
    pieces = cut_pieces(docs, tokenizer, pattern, capacity, end_id)
    return pieces.join(cut_lineage(pack(pieces, capacity)), "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: one row for each sequence, whose pieces it gathers (no more than the capacity)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
