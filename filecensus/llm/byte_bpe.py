"""Byte-level BPE over rank files: encoding by a segment tree of pair ranks, and decoding.

A piece of text is a row of bytes. Over the byte positions stands a segment tree whose leaf p holds the rank of
the pair that starts at p and whose inner nodes hold the smaller rank of their children; descending to the left
whenever both are equal finds the leftmost pair of least rank. A merge changes three leaves (the pair itself, the
pair before it and the pair it swallowed), each a logarithmic climb. Pieces of similar length take these steps
together, as rows of NumPy arrays; a very long piece runs alone over plain lists.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from filecensus.llm.joins import fresh
from filecensus.llm.words import Cutter, Remembered, give_back, list_array, rows_of, steps

_NONE = np.int32(2**31 - 1)
# Pieces of more bytes run one by one; up to so many bytes of pieces run together.
_ALONE = 256
_TOGETHER = 1 << 18


class Ranks:
    """The vocabulary of a rank file: ranks are the token ids."""

    def __init__(self, path: str):
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, merged = array("q"), array("i")
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        keys = np.frombuffer(keys, dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**63 - 1))
        self.merged = np.append(np.frombuffer(merged, dtype=np.int32)[order], _NONE)

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """The same as a dict, for long pieces that run alone."""
        return dict(zip(self.keys[:-1].tolist(), self.merged[:-1].tolist(), strict=True))

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs; none where there is no such token or either side is -1."""
        wanted = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.merged[at], _NONE)


@functools.cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _merge_together(vocabulary: Ranks, pieces: list[bytes], width: int) -> list[list[int]]:
    """Merge pieces of 2 to `width` bytes (a power of two), step by step in all rows."""
    rows = len(pieces)
    lengths = np.array([len(x) for x in pieces])
    inside = np.arange(width)[None, :] < lengths[:, None]
    # One column more on each side of the symbols stands for "no neighbour".
    symbols = np.full((rows, width + 1), -1, dtype=np.int64)
    symbols[:, :width][inside] = vocabulary.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after = np.tile(np.arange(1, width + 2), (rows, 1))
    after[np.arange(rows), lengths - 1] = width
    before = np.tile(np.arange(-1, width), (rows, 1))
    before[:, 0] = width
    tree = np.full((rows, 2 * width), _NONE, dtype=np.int32)
    tree[:, width:2 * width - 1] = vocabulary.of_pairs(symbols[:, :width - 1], symbols[:, 1:width])
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    alive = inside.copy()

    def put(at: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[at, node] = value
        while node[0] > 1:
            node >>= 1
            tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])

    at = np.flatnonzero(tree[:, 1] != _NONE)
    while len(at):
        least, node = tree[at, 1], np.ones(len(at), dtype=np.int64)
        for _ in range(width.bit_length() - 1):
            node = 2 * node
            node += tree[at, node] != least
        left = node - width
        right = after[at, left]
        beyond = after[at, right]
        symbols[at, left] = least
        alive[at, right] = False
        after[at, left] = beyond
        inner = beyond < width
        before[at[inner], beyond[inner]] = left[inner]
        put(at, right, np.full(len(at), _NONE))
        put(at, left, vocabulary.of_pairs(symbols[at, left], symbols[at, beyond]))
        first = before[at, left]
        has = first < width
        if has.any():
            put(at[has], first[has], vocabulary.of_pairs(symbols[at[has], first[has]], least[has].astype(np.int64)))
        at = at[tree[at, 1] != _NONE]
    kept = symbols[:, :width][alive].tolist()
    ends = np.cumsum(alive.sum(axis=1)).tolist()
    return [kept[begin:end] for begin, end in zip([0, *ends], ends, strict=False)]


def _merge_alone(vocabulary: Ranks, piece: bytes) -> list[int]:
    """The same steps for one long piece, over lists."""
    none, get = int(_NONE), vocabulary.pairs.get
    width = 1 << (len(piece) - 1).bit_length()
    symbols = vocabulary.first[np.frombuffer(piece, dtype=np.uint8)].tolist()
    size = len(symbols)
    tree = [none] * (2 * width)
    for i in range(size - 1):
        tree[width + i] = get(symbols[i] << 32 | symbols[i + 1], none)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = [*range(1, size), -1], [*range(-1, size - 1)]

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    while (least := tree[1]) != none:
        node = 1
        while node < width:
            node *= 2
            node += tree[node] != least
        left = node - width
        right = after[left]
        beyond = after[right]
        symbols[left], symbols[right] = least, -1
        after[left] = beyond
        put(right, none)
        put(left, none if beyond < 0 else get(least << 32 | symbols[beyond], none))
        if beyond >= 0:
            before[beyond] = left
        if (first := before[left]) >= 0:
            put(first, get(symbols[first] << 32 | least, none))
    return [x for x in symbols if x >= 0]


def merge(vocabulary: Ranks, pieces: list[bytes]) -> list[list[int]]:
    """Token ids of each piece, every piece on its own. A piece that is a token itself is that token."""
    found: list[list[int] | None] = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if (rank := vocabulary.ranks.get(piece)) is not None:
            found[i] = [rank]
        elif not piece:
            found[i] = []
        elif len(piece) > _ALONE:
            found[i] = _merge_alone(vocabulary, piece)
        else:
            classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for width, members in classes.items():
        rows = _TOGETHER // width
        for begin in range(0, len(members), rows):
            some = members[begin:begin + rows]
            for i, ids in zip(some, _merge_together(vocabulary, [pieces[i] for i in some], width), strict=True):
                found[i] = ids
    return found


class Encoder:
    """Encodes texts with a rank file and a pattern; remembers the matches it has met."""

    def __init__(self, path: str, pattern: str):
        vocabulary = ranks(path)
        self.cut = Cutter(pattern)
        self.remembered = Remembered(lambda new: merge(vocabulary, [match.encode() for match in new]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and how many each text has."""
        values, sizes = self.remembered.look_up_cut(*self.cut(texts))
        return values.astype(np.int32), sizes


@functools.cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids: each match of `pattern` encoded separately by the ranks in the file at `path`.

    Special tokens are ordinary text. Null and empty texts give an empty array; what the pattern does not match
    is left out. The file must be readable at that path on every executor.
    """
    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path, pattern)
        for texts in batches:
            yield list_array([encoder.encode(some) for some in steps(texts)])

    return ids(text.cast("string"))


def decode(ids: Column, path: str) -> Column:
    """binary: the bytes of the token ids. Null and empty arrays give no bytes; a null or unknown id is an error."""
    @F.arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = ranks(path).tokens
        for lists in batches:
            yield pa.array([b"".join(map(tokens.__getitem__, row or ())) for row in rows_of(lists)], type=pa.binary())

    return text(ids)


def with_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All rows and columns, with `ids`, `n_tokens` and `round_trip` (do the ids decode to the text) besides.

    A name that `docs` has already gets underscores in front. As for `encode` and `decode`; texts are taken a
    bounded number of bytes at a time.
    """
    names = [fresh(docs, name) for name in ("ids", "n_tokens", "round_trip")]
    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(
        names, (ArrayType(IntegerType()), LongType(), BooleanType()), strict=True)]])
    at = docs.columns.index("text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder, tokens = _encoder(path, pattern), ranks(path).tokens
        for batch in batches:
            begin = 0
            for some in steps(batch.column(at).cast(pa.string())):
                values, counts = encoder.encode(some)
                ends = np.cumsum(counts)
                whole = [b"".join(map(tokens.__getitem__, values[i:j].tolist())) == text.encode()
                         for i, j, text in zip(ends - counts, ends, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(begin, len(some)).columns, list_array([(values, counts)]),
                     pa.array(counts.astype(np.int64)), pa.array(whole)], names=[*batch.schema.names, *names])
                begin += len(some)

    return docs.mapInArrow(encoded, schema)


def digests(text: Column, path: str, pattern: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of the ids of a text and of the bytes they decode to.

    Hex sha256 of the decimal ids joined by one space, and of the decoded bytes. Null counts as empty.
    """
    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, tokens = _encoder(path, pattern), ranks(path).tokens
        for texts in batches:
            sizes, of_ids, of_bytes = [], [], []
            for some in steps(texts):
                values, counts = encoder.encode(some)
                for ids in np.split(values, np.cumsum(counts)[:-1]):
                    row = ids.tolist()
                    sizes.append(len(row))
                    of_ids.append(hashlib.sha256(" ".join(map(str, row)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(b"".join(map(tokens.__getitem__, row))).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text.cast("string"))
