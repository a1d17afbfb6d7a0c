"""Removing byte strings that occur more than once, by prefix doubling over sampled positions.

A string of LENGTH bytes is repeated if it starts at two places. Ranking all suffixes would move every byte
position in each round. Instead, positions are sampled by what stands there: of the GRAM-byte strings inside a
LENGTH-byte string, the leftmost of least hash marks it. Equal strings are marked at equal offsets, and each mark
stands for the run of strings (windows) that it marks. Hashes of GRAM bytes are made in each text by doubling.

Then ranks are doubled over the marks. In each round the table has, for each mark and cell of offsets, its rank so
far and the name of the string that all windows of the cell share. Spark groups these pairs and gives equal pairs
one rank. A rank held once is unique: no window of it is repeated. A rank held by marks whose windows are alike as a
whole is past the threshold: they are all repeated. The others go on with finer cells, whose shared strings are
longer, up to single windows of LENGTH bytes. Only what neither test settles is carried on.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from filecensus.llm.joins import join_listed, small_side
from filecensus.llm.words import give_back
from filecensus.operators.scale import cut_lineage, drop, new_table

LENGTH = 200
# Offsets of windows from their mark run from 0 to OFFSETS - 1; a power of two.
OFFSETS = 128
GRAM = LENGTH - OFFSETS + 1
# Offsets in a cell, round by round: the shared strings have GRAM, 169, 193 and 200 bytes.
CELLS = (OFFSETS, 32, 8, 1)
# Bytes of text that are marked at a time; longer texts are marked in overlapping pieces.
PIECE = 1 << 20


def _grow(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the string that two neighbouring strings make, for all positions."""
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29)))
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position, from those of 1, 2, 4, ... bytes."""
    size, hashes, whole, done = 1, _byte_hashes()[data], None, 0
    while True:
        if GRAM & size:
            own = hashes[done:]
            whole = own if whole is None else _grow(whole[:len(own)], own)
            done += size
        if 2 * size > GRAM:
            return whole
        hashes = _grow(hashes[:-size], hashes[size:]) if len(hashes) > size else hashes[:0]
        size *= 2


@functools.cache
def _byte_hashes() -> np.ndarray:
    numbers = np.arange(1, 257, dtype=np.uint64)
    return _grow(numbers, numbers * np.uint64(0xD1342543DE82EF95))


def marks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marks of several texts that stand one behind the other and end at `ends`.

    Returns the position of each mark, the first and last window that it stands for, and its GRAM-byte hash.
    """
    count = len(data) - LENGTH + 1
    if count <= 0:
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.uint64),)
    hashes = gram_hashes(data)
    # Least hash first, then leftmost; positions fit the lower half.
    least = ((hashes >> np.uint64(32)) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size < OFFSETS:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    at = (least[:count] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(text, ends[:-1], 1)
    text = np.cumsum(text)[:count]
    inside = np.arange(count) + LENGTH <= ends[text]
    new = np.ones(count, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], count) - 1
    some = inside[first]
    first, last = first[some], last[some]
    return at[first], first, last, hashes[at[first]]


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, where the piece begins, piece) in lists of bounded bytes; neighbours overlap by all but one byte of a
    window, so that each window is in one piece."""
    held, total = [], 0
    for i, text in enumerate(texts):
        for begin in range(0, max(0, len(text) - LENGTH + 1), PIECE):
            piece = text[begin:begin + PIECE + LENGTH - 1]
            if held and total + len(piece) > PIECE:
                yield held
                held, total = [], 0
            held.append((i, begin, piece))
            total += len(piece)
    if held:
        yield held


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """read_key, place (what tells this mark from marks of other texts and positions), gram and packed position."""
    for batch in batches:
        keys = batch.column("read_key").to_numpy()
        texts_keys = batch.column("text_key").to_numpy().view(np.uint64)
        for held in _pieces([x or b"" for x in batch.column("text").to_pylist()]):
            ends = np.cumsum([len(piece) for _, _, piece in held])
            at, first, last, grams = marks(np.frombuffer(b"".join(x for _, _, x in held), dtype=np.uint8), ends)
            piece = np.searchsorted(ends, at, side="right")
            owner = np.array([i for i, _, _ in held])[piece]
            moved = (np.array([begin for _, begin, _ in held]) - ends + [len(x) for _, _, x in held])[piece]
            place = _grow(texts_keys[owner], (at + moved).astype(np.uint64))
            packed = (at + moved) << 14 | (at - last) << 7 | (at - first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[owner]), pa.array(place.view(np.int64)), pa.array(grams.view(np.int64)),
                 pa.array(packed)], names=["read_key", "place", "gram", "packed"])


_ROW = ("read_key bigint, at bigint, low int, high int, cell int, name binary, alike binary, context binary, "
        "rank bigint, open boolean")
_ROW_NAMES = ["read_key", "at", "low", "high", "cell", "name", "alike", "context", "rank", "open"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(),
          pa.int64(), pa.bool_()]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _cells(size: int, key: int, at: int, low: int, high: int, context: bytes, rank: int,
           open_: bool) -> Iterator[tuple]:
    """The rows of a mark for each cell of `size` offsets that its windows lie in.

    `context` is the text from the window at offset `high` to the end of the one at offset `low`.
    """
    for cell in range(low // size, high // size + 1):
        begin, end = cell * size, cell * size + size - 1
        some_low, some_high = max(low, begin), min(high, end)
        # All windows of the cell share the text from offset `begin` to the end of the one at offset `end`.
        shared = context[high - begin if high > begin else 0:high - end + LENGTH] if high >= begin else b""
        if size == 1:  # one window: what is named alike is alike, and nothing comes after
            yield key, at, some_low, some_high, cell, _digest(shared), b"", b"", rank, open_
            continue
        part = context[high - some_high:high - some_low + LENGTH]
        yield (key, at, some_low, some_high, cell, _digest(shared), _digest(b"%d %d " % (some_low, some_high) + part),
               part, rank, open_)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)],
                                      names=_ROW_NAMES)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first rows of the marks that are left, with the text around them."""
    for batch in batches:
        give_back()
        rows = []
        for key, text, packed in zip(*(batch.column(c) for c in ("read_key", "text", "marks")), strict=True):
            text = text.as_py()
            for x in packed.as_py():
                at, low, high = x >> 14, x >> 7 & 127, x & 127
                rows += _cells(OFFSETS, key.as_py(), at, low, high, text[at - high:at - low + LENGTH], 0, True)
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _finer(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        give_back()
        columns = [batch.column(c).to_pylist() for c in ("read_key", "at", "low", "high", "context", "rank", "open")]
        rows = []
        for one in zip(*columns, strict=True):
            rows += _cells(size, *one)
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _settle(rows: DataFrame, last: bool) -> DataFrame:
    """One round: rerank, drop unique ranks, and count the marks that are alike as a whole.

    Only keys are moved, not the texts around the marks. In the last round a row is one window, and rows of one rank are
    alike.
    """
    pair = ["rank", "cell", "name"]
    keys = rows.select("id", "read_key", "at", "low", "high", *pair, "alike", "open")
    ranks = keys.groupBy(*pair).agg(
        F.min("id").alias("fresh"), F.count(F.lit(1)).alias("n"), F.max("open").alias("some_open"))
    alike = keys.groupBy("alike").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("same"))
    shared = keys.join(ranks.filter("n > 1 AND some_open"), pair)
    if last:
        return cut_lineage(shared.select(
            "id", "read_key", "at", "low", "high", "fresh", "open", F.col("fresh").alias("first"), F.col("n").alias("same")))
    return cut_lineage(shared.join(alike, "alike").select(
        "id", "read_key", "at", "low", "high", "fresh", "open", "first", "same"))


def _double(rows: DataFrame) -> DataFrame:
    """All rounds over the first rows: read_key, start and end of strings that are repeated."""
    spark, found, before = rows.sparkSession, [], None
    for number, cell in enumerate(CELLS):
        if number:
            rows = rows.mapInArrow(functools.partial(_finer, cell), _ROW)
        folder = new_table(spark)
        # The number of a row must not change when it is read again.
        rows.withColumn("id", F.monotonically_increasing_id()).write.parquet(folder)
        if before is not None:
            drop(spark, before)
        rows, before = spark.read.parquet(folder), folder
        last = number == len(CELLS) - 1
        told = _settle(rows, last)
        found.append(told.filter("open AND same > 1").select(
            "read_key", (F.col("at") - F.col("high")).cast("int").alias("start"),
            (F.col("at") - F.col("low") + LENGTH).cast("int").alias("end")))
        if last:
            break
        # Of rows alike as a whole one goes on, for others to be compared with.
        onward = cut_lineage(told.filter("same = 1 OR id = first").select(
            "id", F.col("fresh").alias("rank"), (F.col("open") & (F.col("same") == 1)).alias("open")))
        rows = join_listed(rows.drop("rank", "open"), onward, "id", 48)
    drop(spark, before)
    return functools.reduce(DataFrame.union, found)


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", text.cast("binary").alias("text"), F.xxhash64(text).alias("text_key"),
        F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), text).alias("read_key"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """read_key and `spans` (start and end, in bytes, sorted, apart) of the repeated bytes of every text that has some.

    read_key stands for a row's doc_id and text, as `_source` makes it.
    """
    source = _source(docs)
    # Texts that occur more than once are repeated as a whole; one row of each text stands for it below.
    whole = F.md5("text")
    signed = cut_lineage(source.select(
        "read_key", whole.alias("whole"), F.octet_length("text").alias("size")).filter(f"size >= {LENGTH}"))
    texts = signed.groupBy("whole").agg(F.min("read_key").alias("read_key"), F.count(F.lit(1)).alias("copies"))
    heads = cut_lineage(texts.select("read_key", "copies"))
    copied = signed.join(texts.filter("copies > 1").select("whole"), "whole").select(
        "read_key", F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end"))).alias("spans"))

    found = source.filter(F.octet_length("text") >= LENGTH).select("read_key", "text_key", "text").mapInArrow(
        _mark_rows, "read_key bigint, place bigint, gram bigint, packed bigint")
    repeated = cut_lineage(found.groupBy("gram").agg(F.min("place").alias("low"), F.max("place").alias("high"))
                           .filter("low <> high").select("gram"))
    left = found.join(small_side(repeated, 16), "gram", "left_semi").join(
        small_side(heads.select("read_key"), 16), "read_key", "left_semi")
    listed = cut_lineage(left.groupBy("read_key").agg(F.collect_set("packed").alias("marks")))
    around = source.select("read_key", "text").join(small_side(listed, 32, "marks", 8), "read_key")

    every = _double(around.mapInArrow(_contexts, _ROW))
    several = cut_lineage(copied.select("read_key").distinct())
    spans = every.join(several, "read_key", "left_anti").groupBy("read_key").agg(
        _merged(F.sort_array(F.collect_set(F.struct("start", "end")))).alias("spans"))
    return spans.union(copied.dropDuplicates(["read_key"]))


def _merged(spans: Column) -> Column:
    """Spans sorted by start, with those that touch or overlap made one: a text has far more strings than runs."""
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def merge(lists: pa.Array) -> pa.Array:
        begin, stop = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
        lengths = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(lists)), lengths) << 32
        # The furthest end so far; a row's are all beyond those of the rows before.
        reach = np.maximum.accumulate(row + stop) if len(row) else row
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row + begin)[1:] > reach[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(row))[:len(first)] - 1
        sizes = np.bincount(row[first] >> 32, minlength=len(lists))
        flat = pa.StructArray.from_arrays(
            [pa.array(begin[first].astype(np.int32)), pa.array((reach - row)[last].astype(np.int32))],
            names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)

    return merge(spans)


def _cut(text: Column, spans: Column) -> Column:
    """struct<kept, n_removed, n_spans>: a text without some spans, sorted by start, which may overlap."""
    @F.arrow_udf("struct<kept:binary,n_removed:bigint,n_spans:bigint>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        kept, removed, runs = [], [], []
        for text, found in zip(texts, lists, strict=True):
            data, parts, done, n = text.as_py(), [], 0, 0
            for span in found.as_py() or ():
                if n == 0 or span["start"] > done:
                    parts.append(data[done:span["start"]])
                    n += 1
                done = max(done, span["end"])
            parts.append(data[done:])
            kept.append(b"".join(parts))
            removed.append(len(data) - len(kept[-1]))
            runs.append(n)
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()),
                                           pa.array(runs, pa.int64())], names=["kept", "n_removed", "n_spans"])

    return cut(text, spans)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and `kept` (the bytes that remain) of every row.

    Removed is each byte covered by a string of LENGTH bytes that also starts anywhere else in any row, be it in
    the same text and overlapping; all strings are judged on the input, and none crosses from one text to another.
    Rows alike in text are repeats of each other. Null texts count as empty, texts shorter than LENGTH have no
    repeats, null and repeated doc_ids stay rows of their own, other columns are not looked at.
    """
    spans = cut_lineage(repeated_spans(docs))
    joined = _source(docs).select("doc_id", "text", "read_key").join(
        small_side(spans, 32, "spans", 24), "read_key", "left")
    return joined.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), _cut(F.col("text"), F.col("spans")).alias(
            "cut")).select("doc_id", "n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept")
