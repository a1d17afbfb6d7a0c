"""Cutting texts into pieces that are worked out once and remembered by number."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Text that one step of a task holds as Python strings.
STEP_BYTES = 1024 * 1024
# Pieces, and values of pieces, that one Python worker remembers before it starts anew.
PIECES = 150_000
VALUES = 3_000_000

# The split of byte-level vocabularies: runs of letters, digits or other characters with one space before them,
# English endings, and white space.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_WHITE, _SPACE, _LETTER, _DIGIT, _OTHER = range(5)


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of every code point, as the engine's classes have it."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    kinds = np.full(0x110000, _OTHER, dtype=np.uint8)
    for kind, members in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_WHITE, r"\s+")):
        for run in regex.finditer(members, every):
            kinds[ord(run[0][0]):ord(run[0][-1]) + 1] = kind
    kinds[ord(" ")] = _SPACE
    return kinds


def _starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a match of BYTE_LEVEL begins, in the code points of texts that end at `ends` (none is empty)."""
    kinds = _kinds()[codes]
    white = kinds <= _SPACE
    first = np.zeros(len(codes) + 1, dtype=bool)
    first[0] = first[ends] = True
    last, first = first[1:], first[:-1]
    before, stays = np.empty_like(kinds), np.empty_like(white)
    before[0], before[1:] = _OTHER, kinds[:-1]
    # A space belongs to the run after it; of more white space, only the last character may.
    stays[-1], stays[:-1] = True, white[1:]
    stays |= last
    starts = np.where(white, (before > _SPACE) | ~stays, (kinds != before) & (before != _SPACE)) | first
    # An ending is cut off where its apostrophe begins a match.
    at = np.flatnonzero((codes == ord("'")) & starts)
    if len(at):
        left = ends[np.searchsorted(ends, at, side="right")] - at
        padded = np.concatenate([codes, np.zeros(2, dtype=codes.dtype)])
        for ending in _ENDINGS:
            hit = left > len(ending)
            for i, letter in enumerate(ending, 1):
                hit &= padded[at + i] == ord(letter)
            some = at[hit]
            starts[some + 1] = False
            beyond = some + 1 + len(ending)
            starts[beyond[beyond < len(starts)]] = True
    return starts


class Cutter:
    """Cuts texts into the matches of a pattern, which come in one Arrow array.

    BYTE_LEVEL is cut by comparing neighbouring characters of all texts at once; other patterns go through the
    regular expression engine.
    """

    def __init__(self, pattern: str):
        self.every = None if pattern == BYTE_LEVEL else regex.compile(pattern).findall

    def __call__(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The matches of all texts, and how many each text has."""
        if self.every is not None:
            rows = [self.every(text) for text in texts]
            return (pa.array(chain.from_iterable(rows), type=pa.string()),
                    np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))
        joined = "".join(texts)
        counts = np.zeros(len(texts), dtype=np.int64)
        if not joined:
            return pa.array([], type=pa.string()), counts
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        some = lengths > 0
        ends = np.cumsum(lengths[some])
        data = joined.encode()
        if len(data) == len(joined):
            starts = np.flatnonzero(_starts(np.frombuffer(data, dtype=np.uint8), ends))
            at = starts
        else:
            codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
            starts = np.flatnonzero(_starts(codes, ends))
            width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            at = (np.cumsum(width) - width)[starts]
        counts[some] = np.diff(np.searchsorted(starts, ends), prepend=0)
        offsets = np.append(at, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), counts


class Remembered(dict):
    """Numbers pieces as they come, and keeps for each the integers that `work` finds for it.

    `work` gets a list of new pieces and returns a sequence of integers for each. Workers live on from stage to
    stage: the one that is used last is the only one in its process that remembers anything.
    """

    in_use: Remembered | None = None

    def __init__(self, work: Callable[[list], Sequence[Sequence[int]]], room: int = PIECES):
        self.work, self.room = work, room
        self._start_anew()

    def _start_anew(self) -> None:
        self.clear()
        self.new: list = []
        self.values = np.empty(1024, dtype=np.int64)
        self.starts, self.sizes = np.empty(1024, dtype=np.int64), np.empty(1024, dtype=np.int64)
        self.known = self.used = 0

    def __missing__(self, piece) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def _learn(self) -> None:
        found = self.work(self.new)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        values = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum()))
        self.values = _put(self.values, self.used, values)
        self.starts = _put(self.starts, self.known, self.used + np.cumsum(sizes) - sizes)
        self.sizes = _put(self.sizes, self.known, sizes)
        self.known, self.used, self.new = self.known + len(sizes), self.used + len(values), []

    def number(self, rows: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces of all rows in one array, and how many each row has."""
        if Remembered.in_use is not self:
            if Remembered.in_use is not None:
                Remembered.in_use._start_anew()
                give_back()
            Remembered.in_use = self
        if len(self) > self.room or self.used > VALUES:
            self._start_anew()
        lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(rows)), dtype=np.int64,
                              count=int(lengths.sum()))
        if self.new:
            self._learn()
        return numbers, lengths

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The integers of numbered pieces in one array, and how many each piece has."""
        sizes = self.sizes[numbers]
        at = np.repeat(self.starts[numbers] - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        return self.values[at], sizes

    def look_up(self, rows: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The integers of all pieces of all rows in one array, and how many each row has."""
        numbers, lengths = self.number(rows)
        values, sizes = self.gather(numbers)
        return values, row_sums(sizes, lengths)

    def look_up_cut(self, pieces: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the pieces of rows of these lengths in one array; only those that differ are looked up."""
        coded = pieces.dictionary_encode()
        numbers, _ = self.number([coded.dictionary.to_numpy(zero_copy_only=False).tolist()])
        values, sizes = self.gather(numbers[coded.indices.to_numpy()])
        return values, row_sums(sizes, lengths)


def give_back() -> None:
    """Give memory that this process has freed back to the system.

    Workers, and the driver, live on from stage to stage, and what one stage has freed would otherwise stay with them in the next.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every system has it
    if trim is not None:
        trim(0)


def row_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of a flat array over rows of these lengths."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(lengths)])])


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    if at + len(values) > len(array):
        array = np.concatenate([array[:at], np.empty(at + 2 * len(values) + 1024, dtype=array.dtype)])
    array[at:at + len(values)] = values
    return array


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[list[str]]:
    """The texts in lists of bounded bytes, or one text alone if it is longer; null counts as empty."""
    pa.default_memory_pool().release_unused()
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin = total = 0
    for end, length in enumerate(lengths):
        if total and total + length > step_bytes:
            yield [x or "" for x in texts.slice(begin, end - begin).to_pylist()]
            begin, total = end, 0
        total += length
    if begin < len(lengths):
        yield [x or "" for x in texts.slice(begin).to_pylist()]


def list_array(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """An Arrow list column of int from flat values and the number of values of each row."""
    if not parts:
        return pa.array([], type=pa.list_(pa.int32()))
    ends = np.cumsum(np.concatenate([sizes for _, sizes in parts]))
    values = np.concatenate([values.astype(np.int32, copy=False) for values, _ in parts])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def rows_of(lists: pa.Array) -> Iterator[list[int]]:
    """The rows of a list column as Python lists, one at a time; null counts as empty."""
    ends = lists.offsets.to_numpy()
    for begin, end in zip(ends[:-1], ends[1:], strict=True):
        yield lists.values.slice(begin, end - begin).to_numpy(zero_copy_only=False).tolist()
