"""Token ids as Parquet files that can be read in part.

One row per document in ascending doc_id order: doc_id, n_tokens, ids (a list of unsigned token ids as int), and
where the row stands (part, offset). `ids` is dictionary-encoded, which packs each id into the bits that the row
group's vocabulary needs; the other columns, which rise or change little, are delta-encoded. Row groups and pages
are small enough to be skipped: files are sorted by doc_id, so a read of some documents opens only row groups
whose statistics meet them and, by the page index, only such pages; a read of counts never touches `ids`.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from filecensus.llm.words import Cutter, Remembered, list_array, steps

ROW_GROUP_BYTES = 32 * 1024 * 1024
PAGE_BYTES = 256 * 1024
PAGE_ROWS = 2_000
# Pieces that a worker remembers: the library takes its time over new ones.
PIECES = 400_000
_SCHEMA = "doc_id {kind}, n_tokens bigint, ids array<int>, part int, offset bigint"


class PieceTokenizer:
    """A byte-level tokenizer of the tokenizers library that remembers the matches of its pattern.

    The library's model encodes each match; a text that holds the string of an added token goes through the
    library as a whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [str(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = Cutter(pattern)
        self.remembered = Remembered(self._work, PIECES)

    def _work(self, new: list[str]) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        data = [piece.encode() for piece in new]
        shown = _SHOWN[np.frombuffer(b"".join(data), dtype=np.uint8)].tobytes().decode("utf-32-le")
        ends = [0, *accumulate(map(len, data))]
        return [[token.id for token in tokenize(shown[i:j])] for i, j in pairwise(ends)]

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, `end` after each, and how many each text has."""
        whole = [any(token in text for token in self.added) for text in texts]
        values, sizes = self.remembered.look_up_cut(*self.cut(
            ["" if special else text for special, text in zip(whole, texts, strict=True)]))
        if any(whole):
            rows = np.split(values, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(whole):
                rows[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.int64)
            values, sizes = np.concatenate(rows), np.array([len(row) for row in rows])
        return np.insert(values, np.cumsum(sizes), end), sizes + 1


def _shown() -> np.ndarray:
    """How byte-level models write bytes: printable ones as themselves, the others as letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = np.full(256, -1)
    shown[printable] = printable
    shown[shown < 0] = np.arange(256, 512 - len(printable))
    return shown.astype("<u4")


_SHOWN = _shown()


@functools.cache
def tokenizer_of(path: str, pattern: str) -> PieceTokenizer:
    """The tokenizer of this Python worker."""
    return PieceTokenizer(path, pattern)


def write(docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int = 0) -> None:
    """Encode `text` of all rows with a tokenizer file and write them to `folder` in ascending doc_id order.

    The file is one of a byte-level BPE tokenizer without normalizer, `pattern` the one that its text is cut by.

    Every document ends with `end_id`, so a null or empty text is that id alone. Special tokens are not added, but
    their strings in a text are taken as the library does by default. Null doc_ids come first, rows of equal
    doc_id stand in any fixed order, other columns are left out, and an empty table gives a folder without rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    # Rows of one doc_id, however many, may spread over tasks: their order is free.
    tie = F.xxhash64("text").alias("_tie")
    ordered = docs.select("doc_id", F.col("text").cast("string"), tie).repartitionByRange("doc_id", "_tie")
    ordered = ordered.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text", F.spark_partition_id())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, offset = tokenizer_of(tokenizer, pattern), 0
        for batch in batches:
            begin = 0
            for texts in steps(batch.column(1)):
                values, counts = pieces.encode(texts, end_id)
                n = counts.astype(np.int64)
                places = offset + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(n)), pa.array(n), list_array([(values, counts)]),
                     batch.column(2).slice(begin, len(n)), pa.array(places)],
                    names=["doc_id", "n_tokens", "ids", "part", "offset"])
                begin += len(n)
                offset += int(n.sum())

    writer = ordered.mapInArrow(encoded, _SCHEMA.format(kind=kind)).write
    for name, value in {
        "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.dictionary.page.size": 1024 * 1024, "compression": "zstd",
    }.items():
        writer = writer.option(name, str(value))
    writer.parquet(folder)


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens and start (ids of all documents before it); `ids` is not read.

    Only one sum per part is added up in one place.
    """
    rows = spark.read.parquet(folder).select("doc_id", "n_tokens", "part", "offset")
    return _with_start(rows, rows)


def _with_start(rows: DataFrame, counts: DataFrame) -> DataFrame:
    sums = counts.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_base"))
    # One row for each task that wrote.
    joined = rows.join(F.broadcast(bases), "part")
    return joined.withColumn("start", F.col("_base") + F.col("offset")).drop("part", "offset", "_base")


def read_tokens(spark: SparkSession, folder: str, first_doc: int | None = None,
                last_doc: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of all documents, or of those from `first_doc` to `last_doc`."""
    every = spark.read.parquet(folder)
    some = every
    if first_doc is not None:
        some = some.filter(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        some = some.filter(F.col("doc_id") <= last_doc)
    return _with_start(some, every.select("part", "offset", "n_tokens")).select("doc_id", "start", "n_tokens", "ids")


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    @F.arrow_udf("bigint")
    def checksum(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            yield pa.array([zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.int64())

    return checksum(ids)
