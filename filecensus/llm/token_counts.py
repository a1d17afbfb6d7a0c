"""Token counts of a sentencepiece BPE model by a compiled finite-state transducer.

BPE encodings have a local rule: a sequence of tokens is an encoding if and only if every two neighbours are the
encoding of their own concatenation. So the last token of each prefix of a text is the only piece that ends there
and fits what stood before it, and reading on needs to know no more than, for each tail of the text that some piece
begins with, the last token before that tail and how many tokens had been counted there. These are the states; they
are finitely many. A transition on a character carries the number of tokens that the count changes by. States and
transitions are worked out when first met and then only looked up.

Where no piece holds two neighbouring characters, the state after them is the start state followed by the second,
whatever came before: a boundary. A chunk of text thus maps every entry state alike once its first boundary is
passed. Its map is (head up to that boundary, tokens between the boundaries, tail after the last one), where states
are named by the text that leads to them from a boundary. Maps compose associatively, so long texts are cut into
chunks that are mapped in parallel, and the maps are put together by a prefix scan.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filecensus.llm.words import Remembered, steps

CHUNK_CHARS = 1 << 15
# States that one Python worker keeps compiled before it starts anew.
STATES = 300_000
# Maps of one document that are composed at a time; each such group becomes one map of the next level.
FAN_IN = 256

_SPACED = re.compile(r" *[^ ]+| +")


class Transducer:
    """The compiled model. Spaces stand for the model's space mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in ids}
        if not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError("the model must have byte pieces")
        if any(" " in piece.lstrip(" ") for piece in self.scores):
            raise ValueError("no piece may hold a space after another character")
        self.begins = {piece[:i] for piece in self.scores for i in range(1, len(piece))}
        self.inside = {piece[i:i + 2] for piece in self.scores for i in range(len(piece) - 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.remembered = Remembered(lambda new: [(self.run(chunk),) for chunk in new])
        self._start_anew()

    def _start_anew(self) -> None:
        self.numbers: dict[tuple, int] = {(): 0}
        self.states: list[tuple] = [()]
        self.lasts = [""]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def _merge(self, symbols: list[str]) -> list[str]:
        """The model's own rule, for the few characters of two pieces: best score first, then leftmost."""
        while True:
            scored = [(self.scores.get(a + b), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
            best = max((x for x in scored if x[0] is not None), default=None)
            if best is None:
                return symbols
            i = -best[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2:]]

    def _fit(self, left: str, right: str) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 4 * STATES:
                self.fits.clear()
            expected = [x for x in (left, right) if x]
            found = self.fits[left, right] = self._merge(list(left + right)) == expected
        return found

    def _step(self, state: int, char: str) -> tuple[int, int]:
        """Compile one transition. A state holds (tail, last token before it, tokens then minus tokens now)."""
        entries = (*self.states[state], ("", self.lasts[state], 0))
        if char not in self.scores:
            return 0, len(char.encode())
        token, change = next(
            (tail + char, tokens + 1) for tail, last, tokens in entries
            if tail + char in self.scores and self._fit(last, tail + char))
        after = []
        for tail, last, tokens in entries:
            if tail + char in self.begins:
                # A token that cannot join with the tail does not matter.
                matters = last and last[-1] + (tail + char)[0] in self.inside
                after.append((tail + char, last if matters else "", tokens - change))
        key = (token, tuple(after)) if after else ()
        number = self.numbers.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key[1])
            self.steps.append({})
            self.lasts.append(token)
        return number, change

    def run(self, text: str) -> int:
        """Tokens of a text that follows a boundary."""
        if len(self.states) > STATES:
            self._start_anew()
        state = total = 0
        steps = self.steps
        for char in text:
            found = steps[state].get(char)
            if found is None:
                found = steps[state][char] = self._step(state, char)
            state, change = found
            total += change
        return total

    def tokens(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts that follow boundaries. The state before a space is a boundary unless that is a space."""
        rows = [_SPACED.findall(text) for text in texts]
        values, sizes = self.remembered.look_up(rows)
        return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(sizes)])])

    def map(self, chunk: str) -> tuple[str, str, str, bool]:
        """(head, text between the first and the last boundary, tail, whether there is a boundary)."""
        inside, size = self.inside, len(chunk)
        first = next((i for i in range(1, size) if chunk[i - 1:i + 1] not in inside), 0)
        if not first:
            return chunk, "", "", False
        last = next(i for i in range(size - 1, 0, -1) if chunk[i - 1:i + 1] not in inside)
        return chunk[:first], chunk[first:last], chunk[last:], True


class ChunkMap(NamedTuple):
    """What a chunk does to any state before it: see the module's text."""

    head: str
    tokens: int
    tail: str
    bounded: bool


def compose(model: Transducer, maps: list[ChunkMap]) -> ChunkMap:
    """The map of chunks that follow each other: neighbours are composed pairwise until one map is left."""
    while len(maps) > 1:
        maps = [_pair(model, *maps[i:i + 2]) for i in range(0, len(maps), 2)]
    return maps[0]


def _pair(model: Transducer, left: ChunkMap, right: ChunkMap | None = None) -> ChunkMap:
    if right is None:
        return left
    between = left.tail + right.head
    if not left.bounded:
        # Joining the two may itself have made a boundary.
        return _refine(model, ChunkMap(left.head + right.head, right.tokens, right.tail, right.bounded))
    if not right.bounded:
        return _shorten(model, left._replace(tail=between))
    return ChunkMap(left.head, left.tokens + int(model.tokens([between])[0]) + right.tokens, right.tail, True)


def _refine(model: Transducer, joined: ChunkMap) -> ChunkMap:
    head, middle, tail, bounded = model.map(joined.head)
    if not bounded:
        return joined
    if not joined.bounded:
        return ChunkMap(head, int(model.tokens([middle])[0]), tail, True)
    return ChunkMap(head, joined.tokens + int(model.tokens([middle + tail])[0]), joined.tail, True)


def _shorten(model: Transducer, joined: ChunkMap) -> ChunkMap:
    head, middle, tail, bounded = model.map(joined.tail)
    if not bounded:
        return joined
    return joined._replace(tokens=joined.tokens + int(model.tokens([head + middle])[0]), tail=tail)


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def whole_map(model: Transducer, parts: list[tuple[str, str, str, bool]]) -> list[ChunkMap]:
    counts = model.tokens([middle for _, middle, _, _ in parts]).tolist()
    return [ChunkMap(head, n, tail, bounded) for (head, _, tail, bounded), n in zip(parts, counts, strict=True)]


def _total(model: Transducer, maps: list[ChunkMap]) -> list[int]:
    ends = model.tokens([text for x in maps for text in (x.head, x.tail)]).reshape(-1, 2).sum(axis=1)
    return [x.tokens + n for x, n in zip(maps, ends.tolist(), strict=True)]


_MAP = "head string, tokens bigint, tail string, bounded boolean"


def _chunks(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk as its map, the chunks of longer ones as they are."""
    model = transducer(path)
    for batch in batches:
        begin = 0
        for texts in steps(batch.column("text")):
            rows: list[tuple] = []
            for i, text in enumerate(texts):
                # The library puts a space in front, and knows its space mark from no space.
                text = f" {text}".replace("▁", " ") if text else ""
                n_bytes = len(texts[i].encode())
                if len(text) <= CHUNK_CHARS:
                    rows.append((begin + i, n_bytes, 0, model.map(text), None))
                else:
                    rows.extend((begin + i, n_bytes, j, None, text[j * CHUNK_CHARS:(j + 1) * CHUNK_CHARS])
                                for j in range(-(-len(text) // CHUNK_CHARS)))
            at, n_bytes, chunk, parts, raw = map(list, zip(*rows, strict=True))
            maps = iter(whole_map(model, [x for x in parts if x]))
            columns = list(zip(*[next(maps) if x else (None,) * 4 for x in parts], strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(at)), batch.column("doc_id").take(pa.array(at)),
                 pa.array(n_bytes, pa.int64()), pa.array(chunk, pa.int32()),
                 *map(pa.array, columns, (pa.string(), pa.int64(), pa.string(), pa.bool_())),
                 pa.array(raw, pa.string())],
                names=["row", "doc_id", "n_bytes", "chunk", *ChunkMap._fields, "raw"])
            begin += len(texts)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row, by the model file at `path`.

    Counts are those of the sentencepiece library for whole texts without begin or end tokens: a space is put in
    front of a text that is not empty, spaces and the space mark are the same, and names of special tokens inside
    texts are ordinary text. Null and empty texts have no tokens; null and repeated doc_ids stay rows of their own;
    other columns are not looked at; an empty table gives an empty result.

    Texts of up to one chunk are mapped where they are. The chunks of longer ones are dealt out to all tasks, and
    their maps are composed in two levels, at most FAN_IN maps at a time on the first.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    kind = dict(docs.dtypes)["doc_id"]
    chunks = rows.mapInArrow(functools.partial(_chunks, path),
                             f"row bigint, doc_id {kind}, n_bytes bigint, chunk int, {_MAP}, raw string")

    @F.arrow_udf(f"struct<{_MAP}>")
    def mapped(raw: pa.Array, known: pa.Array) -> pa.Array:
        model = transducer(path)
        maps = iter(whole_map(model, [model.map(x) for x in raw.to_pylist() if x is not None]))
        return _structs([tuple(old.values()) if text is None else next(maps)
                         for text, old in zip(raw.to_pylist(), known.to_pylist(), strict=True)])

    @F.arrow_udf(f"struct<{_MAP}>")
    def composed(lists: pa.Array) -> pa.Array:
        model = transducer(path)
        return _structs([compose(model, [ChunkMap(*x["map"].values()) for x in row]) for row in lists.to_pylist()])

    @F.arrow_udf("bigint")
    def total(maps: pa.Array) -> pa.Array:
        return pa.array(_total(transducer(path), [ChunkMap(*x.values()) for x in maps.to_pylist()]), pa.int64())

    keys = ["row", "doc_id", "n_bytes"]
    level = chunks.repartition("row", "chunk").select(
        *keys, "chunk", mapped("raw", F.struct(*ChunkMap._fields)).alias("map"))
    for group in (F.floor(F.col("chunk") / FAN_IN).cast("int"), F.lit(0)):
        level = level.groupBy(*keys, group.alias("group")).agg(
            F.sort_array(F.collect_list(F.struct("chunk", "map"))).alias("maps")).select(
            *keys, F.col("group").alias("chunk"), composed("maps").alias("map"))
    counted = level.select("doc_id", "n_bytes", total("map").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _structs(rows: list[tuple]) -> pa.Array:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = (pa.string(), pa.int64(), pa.string(), pa.bool_())
    return pa.StructArray.from_arrays(list(map(pa.array, columns, types)), names=list(ChunkMap._fields))
