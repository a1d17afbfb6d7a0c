"""Packing into sequences against exact search and the tokenizers library."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import as_docs, rows_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filecensus.llm import packing
from filecensus.llm.queries import QUERIES

JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    @functools.cache
    def rest(left, gap):
        if not left:
            return 0
        found = len(left)
        for i, x in enumerate(left):
            others = left[:i] + left[i + 1:]
            found = min(found, rest(others, gap - x) if x <= gap else 1 + rest(others, capacity - x))
        return found

    return rest(tuple(sorted(lengths)), 0)


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 10), min_size=1, max_size=7))
def test_few_pieces_take_the_fewest_bins_or_one_more(lengths):
    table = pa.table({"row": np.arange(len(lengths)), "length": lengths,
                      "sequence_id": pa.nulls(len(lengths), pa.int64()), "offset": pa.nulls(len(lengths), pa.int64())})
    found = packing._pack_group(10, table)
    check_bins(list(zip(found["length"].to_pylist(), found["sequence_id"].to_pylist(), found["offset"].to_pylist(),
                        strict=True)), 10)
    assert sorted(found["row"].to_pylist()) == list(range(len(lengths)))
    assert len(set(found["sequence_id"].to_pylist())) <= fewest(lengths, 10) + 1


def test_each_piece_makes_the_sum_of_squares_smallest():
    rng = random.Random(7)
    for free in (0, 5, 10**6):
        lengths = [rng.randint(1, 12) for _ in range(200)]
        where, begun = packing.sums_of_squares(lengths, 12, free)
        gaps, count = {}, 0
        for length, one in zip(lengths, where, strict=True):
            def total(gap, gaps=gaps, length=length, one=one):
                after = {**gaps, one: gap - length}
                return sum(list(after.values()).count(g) ** 2 for g in set(after.values()) if g)

            def moved(other, gap, gaps=gaps, length=length):
                after = {**gaps, other: gap - length}
                return sum(list(after.values()).count(g) ** 2 for g in set(after.values()) if g)

            options = [moved(other, gap) for other, gap in gaps.items() if gap >= length]
            if not options or count < free:
                options.append(moved("new", 12))
            assert total(gaps.get(one, 12)) == min(options)
            count += one not in gaps
            gaps[one] = gaps.get(one, 12) - length
            assert gaps[one] >= 0
        assert begun == len(gaps)


def check_bins(rows, capacity):
    bins = {}
    for length, sequence, offset in rows:
        bins.setdefault(sequence, []).append((offset, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("group", [50, 10_000])
def test_rounds_over_groups(spark, group):
    rng = random.Random(2)
    lengths = [min(100, 1 + int(rng.expovariate(0.05))) for _ in range(900)] + [100] * 7
    table = spark.createDataFrame(list(enumerate(lengths)), "row bigint, length int")
    placed = [(lengths[row.row], row.sequence_id, row.offset) for row in packing.pack(table, 100, group).collect()]
    assert sorted(x[0] for x in placed) == sorted(lengths)
    check_bins(placed, 100)
    assert len({x[1] for x in placed}) <= -(-sum(lengths) // 100) + 2


def test_lengths_that_never_fit_end(spark):
    table = spark.createDataFrame([(i, 60) for i in range(300)], "row bigint, length int")
    found = packing.pack(table, 100, 20).collect()
    assert len({row.sequence_id for row in found}) == len(found) == 300
    assert packing.pack(table.limit(0), 100).collect() == []


def test_documents(spark, docs, no_docs):
    library = Tokenizer.from_file(JSON)
    packed = packing.pack_documents(docs, JSON, PATTERN, 64).cache()
    whole = sorted(((doc, tuple(library.encode(text or "", add_special_tokens=False).ids) + (0,))
                    for doc, text in docs.select("doc_id", "text").collect()), key=repr)
    rows = packed.collect()
    check_bins([(row.length, row.sequence_id, row.offset) for row in rows], 64)
    texts = {}
    for row in sorted(rows, key=lambda row: (repr(row.doc_id), row.piece)):
        assert len(row.ids) == row.length <= 64 and (row.piece == 0 or row.length == 64)
        texts.setdefault(row.doc_id, []).append(row)
    for doc, ids in whole:
        mine = [x for x in whole if x[0] == doc]
        if len(mine) == 1:
            assert tuple(i for row in texts[doc] for i in row.ids) == ids
            assert [row.start for row in texts[doc]] == [sum(r.length for r in texts[doc][:k]) for k in range(len(texts[doc]))]
    assert sum(row.length for row in rows) == sum(len(x[1]) for x in whole)
    filled = {row.sequence_id: row.ids for row in packing.sequences(packed).collect()}
    for row in rows:
        assert filled[row.sequence_id][row.offset:row.offset + row.length] == row.ids
    assert sum(map(len, filled.values())) == sum(row.length for row in rows)
    assert packing.pack_documents(no_docs, JSON, PATTERN).collect() == []


def test_query(spark, tmp_path):
    texts = [None, "", "short", "long " * 5000, "a" * 9000]
    as_docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(JSON)
    rows = QUERIES["op13_sum_of_squares_packing"](spark, str(tmp_path)).orderBy("doc_id", "piece").collect()
    expected = []
    for doc, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        head = len(ids) % 2048 or 2048
        for piece, end in enumerate(range(head, len(ids) + 1, 2048)):
            start = 0 if piece == 0 else end - 2048
            expected.append((doc, piece, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4"))))
    assert [tuple(row)[:5] for row in rows] == expected
    assert rows_of(spark.createDataFrame(rows).groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048"), "n") == []
