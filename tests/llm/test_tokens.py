"""Token counts, byte-level BPE and token files against the libraries."""

import base64
import glob
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet
import pytest
import sentencepiece
import tiktoken
from conftest_llm import as_docs, rows_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filecensus.llm import byte_bpe, token_counts, token_files, words
from filecensus.operators.scale import new_table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
TEXT = st.text(st.one_of(st.sampled_from("  \n\t ab'sAe1é▁<|>你　\x85"), st.characters(exclude_categories=["Cs"])))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tik():
    lines = map(bytes.split, open(RANKS, "rb"))
    return tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={},
                             mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines})


def count_in_chunks(text, width):
    model = token_counts.transducer(MODEL)
    text = f" {text}".replace("▁", " ") if text else ""
    chunks = [text[i:i + width] for i in range(0, max(1, len(text)), width)]
    maps = token_counts.whole_map(model, [model.map(chunk) for chunk in chunks])
    return token_counts._total(model, [token_counts.compose(model, maps)])[0]


@settings(max_examples=300, deadline=None)
@given(text=TEXT, width=st.integers(1, 9))
def test_transducer_counts_in_any_chunks(library, text, width):
    assert count_in_chunks(text, width) == len(library.encode(text))


def test_maps_compose_in_any_grouping(library):
    rng = random.Random(2)
    model = token_counts.transducer(MODEL)
    for _ in range(50):
        text = " " + "".join(rng.choice("aab e\n.") for _ in range(60))
        maps = token_counts.whole_map(model, [model.map(text[i:i + 5]) for i in range(0, len(text), 5)])
        k = rng.randint(1, len(maps) - 1)
        parts = [token_counts.compose(model, maps[:k]), token_counts.compose(model, maps[k:])]
        assert token_counts._total(model, [token_counts.compose(model, parts)]) == [len(library.encode(text[1:]))]


def test_counts_of_odd_documents(spark, docs, no_docs, library, monkeypatch):
    expected = sorted(
        ((row.doc_id, len((row.text or "").encode()), n := len(library.encode(row.text or "")), n > 100)
         for row in docs.select("doc_id", "text").collect()), key=repr)
    found = token_counts.count_tokens(docs, MODEL, limit=100)
    assert rows_of(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.count_tokens(no_docs, MODEL).collect() == []


def test_long_texts_are_composed_from_many_chunks(spark, library):
    rng = random.Random(1)
    long = "".join(rng.choice("etaoin shr\n") for _ in range(11 * token_counts.CHUNK_CHARS))
    unbroken = "a" * (3 * token_counts.CHUNK_CHARS + 17)
    found = token_counts.count_tokens(as_docs(spark, [long, unbroken]), MODEL)
    assert rows_of(found, "doc_id", "n_tokens") == [(0, len(library.encode(long))), (1, len(library.encode(unbroken)))]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, max_size=5))
def test_segment_tree_encodes_as_the_library(tik, texts):
    library = tik
    values, sizes = byte_bpe._encoder(RANKS, PATTERN).encode(texts)
    rows = np.split(values, np.cumsum(sizes)[:-1]) if texts else []
    assert [row.tolist() for row in rows] == [library.encode_ordinary(text) for text in texts]


def test_long_pieces_merge_alike_together_and_alone(tik):
    vocabulary = byte_bpe.ranks(RANKS)
    rng = random.Random(4)
    for size in (2, 3, 31, 32, 33, 255, 256):
        piece = bytes(rng.choice(b"abcab e") for _ in range(size))
        width = 1 << (size - 1).bit_length()
        together = byte_bpe._merge_together(vocabulary, [piece, piece[:2]], width)
        assert together[0] == byte_bpe._merge_alone(vocabulary, piece) == tik._encode_single_piece(piece) or (
            piece in vocabulary.ranks)


def test_encoding_and_decoding_odd_documents(docs, no_docs, tik):
    ids = docs.select("doc_id", "text", byte_bpe.encode(F.col("text"), RANKS, PATTERN).alias("found"))
    both = ids.select("text", "found", byte_bpe.decode(F.col("found"), RANKS).alias("back"),
                      byte_bpe.digests(F.col("text"), RANKS, PATTERN).alias("digest"))
    for row in both.collect():
        expected = tik.encode_ordinary(row.text or "")
        assert row.found == expected and bytes(row.back) == (row.text or "").encode()
        assert row.digest.n_tokens == len(expected)
        assert row.digest.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert row.digest.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert no_docs.select(byte_bpe.encode(F.col("text"), RANKS, PATTERN)).collect() == []


def test_documents_with_their_tokens(docs, no_docs, tik):
    found = byte_bpe.with_tokens(docs, RANKS, PATTERN)
    assert found.columns[:len(docs.columns)] == docs.columns  # which has ids and n_tokens of its own
    names = found.columns[len(docs.columns):]
    assert names == ["_ids", "_n_tokens", "round_trip"]
    for row in found.collect():
        assert row["_ids"] == tik.encode_ordinary(row.text or "") and row["_n_tokens"] == len(row["_ids"])
        assert row.round_trip and row["ids"] == "x"
    assert byte_bpe.with_tokens(no_docs, RANKS, PATTERN).collect() == []


def test_pieces_are_forgotten_when_there_are_too_many():
    remembered = words.Remembered(lambda new: [(len(x), 7) for x in new], room=3)
    for _ in range(3):
        values, sizes = remembered.look_up([["a", "bb"], [], ["ccc", "dddd", "a"]])
        assert values.tolist() == [1, 7, 2, 7, 3, 7, 4, 7, 1, 7] and sizes.tolist() == [4, 0, 6]


def test_token_files(spark, docs, no_docs):
    library = Tokenizer.from_file(JSON)
    folder = new_table(spark)
    token_files.write(docs, folder, JSON, PATTERN)
    rows = token_files.read_tokens(spark, folder).select(
        "*", token_files.ids_crc32(F.col("ids")).alias("crc")).orderBy("start").collect()
    ids = [row.doc_id for row in rows]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    expected = sorted((library.encode(text or "", add_special_tokens=False).ids + [0] for (text,) in
                       docs.select("text").collect()))
    assert sorted(row.ids for row in rows) == expected
    start = 0
    for row in rows:
        assert row.start == start and row.n_tokens == len(row.ids)
        assert row.crc == zlib.crc32(np.array(row.ids, dtype="<u4").tobytes())
        start += row.n_tokens
    some = token_files.read_tokens(spark, folder, 3, 9)
    assert [(row.doc_id, row.start) for row in some.orderBy("doc_id").collect()] == [
        (row.doc_id, row.start) for row in rows if row.doc_id is not None and 3 <= row.doc_id <= 9]
    counts = token_files.read_counts(spark, folder)
    assert re.search(r"[\[, ]ids#", counts._jdf.queryExecution().executedPlan().toString()) is None
    assert sorted(row.start for row in counts.collect()) == [row.start for row in rows]
    empty = new_table(spark)
    token_files.write(no_docs, empty, JSON, PATTERN)
    assert token_files.read_tokens(spark, empty).collect() == []


def test_token_file_encodings(spark, docs):
    folder = new_table(spark)
    token_files.write(docs, folder, JSON, PATTERN)
    encodings = {}
    for file in glob.glob(f"{folder.removeprefix('file:')}/*.parquet"):
        meta = pyarrow.parquet.ParquetFile(file).metadata
        for group in range(meta.num_row_groups):
            for column in range(meta.num_columns):
                one = meta.row_group(group).column(column)
                encodings.setdefault(one.path_in_schema, set()).update(one.encodings)
                assert one.has_offset_index
    assert any("DICTIONARY" in x for x in encodings["ids.list.element"])
    assert "DELTA_BINARY_PACKED" in encodings["doc_id"] and "DELTA_BINARY_PACKED" in encodings["offset"]
