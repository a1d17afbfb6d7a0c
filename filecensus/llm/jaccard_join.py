"""Near-duplicate texts by MinHash banding, verified on their full sets of n-grams.

Texts of equal words are one class. Each class has a signature of rows * bands minima, cut into bands; classes that
agree in a band are candidates. Groups of classes that candidates connect are cut into blocks, and every pair of
blocks is one task's matrix of similarities: pairs that agree in some band are verified on their n-gram sets. A
tile returns, for each of its classes, the number of documents it links to and one class of the piece of the group
that it belongs to there, so no table of pairs is ever made, however large a group is.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from filecensus.llm.components import TILE, connected, tile_result
from filecensus.llm.joins import fresh, row_key, small_side
from filecensus.llm.words import Remembered, steps
from filecensus.operators.scale import cut_lineage, cut_lineage_counted, lookup

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.995
ROWS = 8
# Classes, and n-grams, that a block holds on average at most; a text of more n-grams is a block's content alone.
BLOCK = 256
BLOCK_GRAMS = 250_000
_COLUMNS = 4096


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of so many rows that a pair at the threshold becomes a candidate with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Reader:
    """n-grams of texts as 64-bit hashes; hashes of words are remembered."""

    def __init__(self, gram: int):
        self.gram = gram
        self.remembered = Remembered(
            lambda new: [(xxhash.xxh64_intdigest(word) - (1 << 63),) for word in new])

    def read(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of all rows of words in one array, and how many each row has. Fewer words are one n-gram."""
        values, lengths = self.remembered.look_up(rows)
        words = values.view(np.uint64)
        counts = np.where(lengths >= self.gram, lengths - self.gram + 1, np.minimum(lengths, 1))
        starts = np.cumsum(lengths) - lengths
        at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        ends = np.repeat(starts + lengths, counts)
        grams = np.zeros(len(at), dtype=np.uint64)
        for i in range(self.gram):
            inside = at + i < ends
            word = words[np.where(inside, at + i, 0)] if len(words) else grams
            grams = np.where(inside, _mix(grams * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(i + 1)), grams)
        return grams, counts


@functools.cache
def _reader(gram: int) -> Reader:
    return Reader(gram)


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return numbers[:n] | np.uint64(1), numbers[n:]


def signatures(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each row that has n-grams."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    found = np.empty((bands, len(starts)), dtype=np.uint64)
    factors, addends = _permutations(bands * rows)
    for band in range(bands):
        mixed = np.full(len(starts), band, dtype=np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((grams ^ addends[i]) * factors[i], starts)
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + least)
        found[band] = mixed
    return found.T.view(np.int64)


def words(text: str) -> list[str]:
    return text.lower().split()


def _sign(gram: int, bands: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin = 0
        for texts in steps(batch.column("text")):
            some = batch.slice(begin, len(texts))
            begin += len(texts)
            split = [words(text) for text in texts]
            grams, counts = _reader(gram).read(split)
            keys = np.array([np.frombuffer(hashlib.blake2b(" ".join(x).encode(), digest_size=16).digest(), np.int64)
                             for x in split])
            found = np.zeros((len(texts), bands), dtype=np.int64)
            if counts.any():
                found[counts > 0] = signatures(grams, counts, bands, rows)
            sizes = np.where(counts > 0, bands, 0)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(found[counts > 0].ravel()))
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), some.column("row"), some.column("read_key"), pa.array(keys[:, 0]),
                 pa.array(keys[:, 1]), pa.array(counts.astype(np.int64)), lists],
                names=["doc_id", "row", "read_key", "k1", "k2", "n_grams", "bands"])


def _grams(gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of n-grams of each candidate, in place of its text."""
    for batch in batches:
        begin = 0
        for texts in steps(batch.column("text")):
            some = batch.slice(begin, len(texts))
            begin += len(texts)
            grams, counts = _reader(gram).read([words(text) for text in texts])
            sets = [np.unique(x).tobytes() for x in np.split(grams, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in _CANDIDATE), pa.array(sets, pa.binary())], names=[*_CANDIDATE, "grams"])


_CANDIDATE = ["node", "copies", "component", "blocks", "bands"]


def _similar(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Which wanted pairs of sets have a Jaccard similarity of at least the threshold."""
    sizes = np.array([len(x) for x in left], dtype=np.float64), np.array([len(x) for x in right], dtype=np.float64)
    smaller = np.minimum(sizes[0][:, None], sizes[1][None])
    wanted = wanted & (smaller >= threshold * np.maximum(sizes[0][:, None], sizes[1][None]) - 1e-6)
    found = np.zeros(wanted.shape, dtype=bool)
    places = np.argwhere(wanted)
    if len(places) <= 48:
        for i, j in places.tolist():
            both = len(np.intersect1d(left[i], right[j], assume_unique=True))
            found[i, j] = both / (len(left[i]) + len(right[j]) - both) >= threshold
        return found
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    _, column, seen = np.unique(every, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])]) if len(column) else column
    both = np.zeros(wanted.shape, dtype=np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, width, _COLUMNS):
        some = slice(*np.searchsorted(column, [begin, begin + _COLUMNS]))
        ones = np.zeros((len(left) + len(right), min(_COLUMNS, width - begin)), dtype=np.float32)
        ones[owner[some], column[some] - begin] = 1
        both += ones[:len(left)] @ ones[len(left):].T
    union = sizes[0][:, None] + sizes[1][None] - both
    return wanted & (both / np.maximum(union, 1) >= threshold)


def _tile(threshold: float, i: int, j: int, table: pa.Table) -> pa.Table:
    """Verify the candidates between two blocks of a group."""
    # A class may come more than once, when several rows are alike in id and text.
    nodes, first = np.unique(table["node"].to_numpy(), return_index=True)
    block = table["block"].to_numpy()[first]
    copies = table["copies"].to_numpy()[first]
    bands = np.stack(table["bands"].to_numpy()[first])
    packed = table["grams"].take(pa.array(first)).to_pylist()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in packed]
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    wanted = np.zeros((len(a), len(b)), dtype=bool)
    for band in bands.T:
        wanted |= band[a][:, None] == band[b][None]
    if i == j:
        wanted &= a[:, None] < b[None]
    linked = _similar([sets[x] for x in a], [sets[x] for x in b], wanted, threshold)
    x, y = np.nonzero(linked)
    return tile_result(nodes, copies, a[x], b[y])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL,
                    rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, n_links and kept of every row.

    Words are what white space separates, in lower case; a text of fewer than `gram` words has one n-gram, one
    without words has none and is linked with nothing. Documents of a Jaccard similarity of at least `threshold`
    are linked; n_links counts them, copies included. class_id is the smallest doc_id that links lead to, itself
    included, and the one row of that doc_id (of several, any one) is kept. A null doc_id comes before all others.
    Other columns are not looked at. A pair at the threshold is found with probability `recall` or more, closer
    ones nearly always; no pair below it is linked.
    """
    source = docs.select("doc_id", F.col("text").cast("string"), row_key().alias("read_key"))
    return _solve(source, F.monotonically_increasing_id(), threshold, gram, recall, rows).drop("row")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL,
                         rows: int = ROWS) -> DataFrame:
    """One row of each group of `near_duplicates`, with all columns of `docs`, which is written once for it."""
    name = fresh(docs, "_row")
    numbered = cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()))
    source = numbered.select("doc_id", F.col("text").cast("string"), F.col(name).alias("read_key"))
    found = _solve(source, F.col("read_key"), threshold, gram, recall, rows)
    dropped = cut_lineage(found.filter("NOT kept").select(F.col("row").alias(name)))
    return numbered.join(small_side(dropped, 16), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _solve(source: DataFrame, row: Column, threshold: float, gram: int, recall: float, rows: int) -> DataFrame:
    """`near_duplicates` of doc_id, text and read_key, which stands for them when they are read again."""
    bands = bands_for(threshold, recall, rows)
    kind, key_kind = (dict(source.dtypes)[c] for c in ("doc_id", "read_key"))
    signed = cut_lineage(source.withColumn("row", row).mapInArrow(
        functools.partial(_sign, gram, bands, rows),
        f"doc_id {kind}, row bigint, read_key {key_kind}, k1 bigint, k2 bigint, n_grams bigint, bands array<bigint>"))

    # A text without n-grams is a class of its own.
    own = F.when(F.col("n_grams") == 0, F.col("row") + 1).otherwise(0).alias("own")
    classes = cut_lineage(signed.groupBy("k1", "k2", own).agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("doc_id", "row")).alias("head"), F.max("n_grams").alias("n_grams")))
    heads = signed.select("row", "read_key", "bands").join(
        classes.filter("n_grams > 0").select(F.col("node").alias("row"), "copies", "n_grams"), "row")
    heads = cut_lineage(heads.withColumnRenamed("row", "node"))

    buckets = heads.select("node", F.posexplode("bands").alias("band", "hash"))
    shared = buckets.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
    candidates = buckets.join(shared.filter("n > 1"), ["band", "hash"]).select(
        F.col("node").alias("a"), F.col("least").alias("b"))
    groups = connected(candidates)

    grouped = heads.join(groups, "node")
    sizes = grouped.groupBy("component").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    wanted = cut_lineage(grouped.join(sizes, "component").select("read_key", *_CANDIDATE))
    sets = source.join(small_side(wanted, 64, "bands", 8), "read_key").select("text", *_CANDIDATE).mapInArrow(
        functools.partial(_grams, gram),
        "node bigint, copies bigint, component bigint, blocks int, bands array<bigint>, grams binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = sets.withColumn("block", block).select(
        "node", "copies", "component", "bands", "grams", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    tiles = tiles.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with")

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        return _tile(threshold, key[1].as_py(), key[2].as_py(), table)

    verified = cut_lineage(tiles.groupBy("component", "i", "j").applyInArrow(tile, TILE))

    linked = connected(verified.select(F.col("node").alias("a"), F.col("other").alias("b")))
    totals = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(linked, "node", "left").join(totals, "node", "left").select(
        "k1", "k2", "own", "copies", "head", F.coalesce("component", "node").alias("component"),
        F.coalesce("links", F.lit(0)).alias("links"))
    first = known.groupBy("component").agg(F.min("head").alias("first"))
    known, seen = cut_lineage_counted(
        known.join(first, "component").select("k1", "k2", "own", "copies", "links", "first"), heaviest=F.max("copies"))
    # A class may be a third of all rows.
    every = lookup(signed.select("doc_id", "row", "k1", "k2", own), known, ["k1", "k2", "own"], "copies", F.col("row"),
                   heaviest=seen["heaviest"] or 0)
    return every.select(
        "doc_id", F.col("first.doc_id").alias("class_id"),
        F.when(F.col("own") == 0, F.col("copies") - 1 + F.col("links")).otherwise(0).alias("n_links"),
        (F.col("row") == F.col("first.row")).alias("kept"), "row")
