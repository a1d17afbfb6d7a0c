"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The random field adds spans that the patterns' letter misses. It reads regions
around digits and at-signs as tokens, and scores whole candidate segments of bounded length by what they look like
as a whole: digits and their grouping, separators, checksums, address parts, what stands before and after. Dynamic
programming over segments chooses boundaries and kinds jointly. Its weights are the maximum-likelihood fit to the
base spans of a bounded sample of documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from filecensus.llm.joins import smallest
from filecensus.llm.words import steps

KINDS = ("email", "ip", "card", "phone")
# Documents, and regions of bounded length among them, that the weights are fitted to.
SAMPLE_DOCS = 2_000
SAMPLE_REGIONS = 1_000
SAMPLE_CHARS = 400
# An entity has at most so many tokens; a region reaches so far from its digits and at-signs.
MAX_TOKENS = 24
REACH = 48
# Log-odds that a chosen segment must have over being no entity.
MARGIN = 2.0

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so the look-behind changes nothing but the time it takes.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_ALLOWED = re.compile(r"[A-Za-z0-9._%+@() -]+")
_FEATURES = 28


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: one can only begin at the head of the run of name characters before an at-sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (match := _EMAIL.match(text, start)):
            yield match.span()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start, then kind."""
    found = [Span(start, 0, end, True) for start, end in _emails(text)]
    if _DIGIT.search(text):
        found += [Span(m.start(), 1, m.end(), True) for m in _IP.finditer(text)
                  if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m[0].split("."))]
        found += [Span(m.start(), 2, m.end(), True) for m in _CARD.finditer(text)
                  if m.end() - m.start() >= 12 and 12 <= len(x := _digits(m[0])) <= 19 and luhn(x)]
        found += [Span(m.start(), 3, m.end(), True) for m in _PHONE.finditer(text)
                  if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and at-signs that stand close to each other."""
    begin = end = -1
    for match in _SIGN.finditer(text):
        at = match.start()
        if begin >= 0 and at > end:
            yield begin, end
            begin = -1
        if begin < 0:
            begin = max(0, at - REACH, end)
        end = min(len(text), at + REACH)
    if begin >= 0:
        yield begin, end


def _features(span: str, before: str, after: str) -> list[int]:
    """Numbers of the features that hold for a whole segment between two characters."""
    digits = _digits(span)
    n, at = len(digits), span.count("@")
    groups = [x for x in re.split(r"[^0-9]+", span) if x]
    found = [0, 1 + min(9, n // 2)]
    letters = any(x.isalpha() for x in span)
    name, _, domain = span.partition("@")
    tests = (
        at == 1, at == 1 and "." in domain, at == 1 and domain.rsplit(".", 1)[-1].isalpha() and bool(name),
        at > 1 or (letters and not at), span.count(".") == 3 and len(groups) == 4 and not letters,
        len(groups) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in groups), 12 <= n <= 19,
        12 <= n <= 19 and luhn(digits), span[0] == "+", "(" in span and ")" in span, "-" in span, " " in span,
        before.isalnum() or before in "@+.", after.isalnum() or after == "@", 9 <= n <= 15, n == len(span),
        span.count("(") != span.count(")"))
    found += [11 + i for i, holds in enumerate(tests) if holds]
    return found


class Region(NamedTuple):
    ends: list[int]  # of its tokens
    segments: list[list[tuple[int, list[int]]]]  # for each end: (first token, features)


def read_region(text: str, begin: int, end: int) -> Region:
    """Tokens of a stretch of text, and the candidate segments that end after each of them."""
    tokens = [m.span() for m in _TOKEN.finditer(text, begin, end)]
    segments: list[list[tuple[int, list[int]]]] = [[] for _ in range(len(tokens) + 1)]
    for i, (start, _) in enumerate(tokens):
        first = text[start]
        if not (first in _LOCAL or first == "("):
            continue
        # Segments go on as long as their characters may stand in an entity.
        reach = _ALLOWED.match(text, start, end).end() if _ALLOWED.match(first) else start
        until = min(reach, tokens[min(len(tokens), i + MAX_TOKENS) - 1][1])
        if "@" not in text[start:until] and (first.isalpha() or not any(c.isdigit() for c in text[start:until])):
            continue
        before = text[start - 1:start]
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            stop = tokens[j][1]
            if stop > until:
                break
            span = text[start:stop]
            if not (span[-1].isalnum() or span[-1] == ")"):
                continue
            n = sum(map(str.isdigit, span))
            if "@" in span or (n >= 4 and n + sum(c in " ().+-" for c in span) == len(span)):
                segments[j + 1].append((i, _features(span, before, text[stop:stop + 1])))
    return Region([stop for _, stop in tokens], segments)


class Field(NamedTuple):
    """weights[kind][feature]; moves[kind before][kind], where the last kind stands for no entity."""

    weights: list[list[float]]
    moves: list[list[float]]

    def best(self, text: str, begin: int, end: int) -> list[tuple[int, int, int]]:
        """The best segmentation of a region: (start, kind, end) of its entities."""
        region = read_region(text, begin, end)
        if not any(region.segments):
            return []
        none, moves = len(KINDS), self.moves
        best, back = [[-math.inf] * none + [0.0]], [[None] * (none + 1)]
        for t in range(1, len(region.ends) + 1):
            scores, origins = [-math.inf] * (none + 1), [None] * (none + 1)
            for kind in range(none + 1):
                if (score := best[t - 1][kind] + moves[kind][none]) > scores[none]:
                    scores[none], origins[none] = score, (t - 1, kind)
            for i, features in region.segments[t]:
                for kind in range(none):
                    own = sum(map(self.weights[kind].__getitem__, features)) - MARGIN
                    if own <= 0:
                        continue
                    for kind_before in range(none + 1):
                        score = best[i][kind_before] + moves[kind_before][kind] + own
                        if score > scores[kind]:
                            scores[kind], origins[kind] = score, (i, kind_before)
            best.append(scores)
            back.append(origins)
        t, kind, found = len(region.ends), max(range(none + 1), key=best[-1].__getitem__), []
        while back[t][kind] is not None:
            i, kind_before = back[t][kind]
            if kind < none:
                found.append((region.ends[i - 1] if i else begin, kind, region.ends[t - 1]))
            t, kind = i, kind_before
        return found[::-1]


def all_spans(text: str, field: Field) -> list[Span]:
    """Base spans, and those of the random field that touch none of them, by start, then kind."""
    found = base_spans(text)
    taken = sorted((span.start, span.end) for span in found)
    added, k = [], 0
    for begin, end in _regions(text):
        for start, kind, stop in field.best(text, begin, end):
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if all(other >= stop for other, other_end in taken[k:k + 8] if other_end > start):
                added.append(Span(start, kind, stop, False))
    return sorted(found + added)


def _gold(text: str, begin: int, region: Region) -> list[tuple[int, int, int]] | None:
    """(first token, kind, end token) of the base spans of a region; None if one is not among the segments."""
    starts = {begin: 0} | {stop: i + 1 for i, stop in enumerate(region.ends)}
    found, done = [], -1
    for span in base_spans(text):
        if span.start < done or span.end <= begin or span.start >= region.ends[-1]:
            continue
        i, j = starts.get(span.start), starts.get(span.end)
        if i is None or j is None or all(first != i for first, _ in region.segments[j]):
            return None
        found.append((i, span.kind, j))
        done = span.end
    return found


def fit(texts: list[str], epochs: int = 8, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximum-likelihood weights for regions given as texts, by AdaGrad on the exact gradient."""
    none = len(KINDS)
    data = []
    for text in texts:
        region = read_region(text, 0, len(text))
        if any(region.segments) and (gold := _gold(text, 0, region)) is not None:
            data.append((region, gold))
    weights, moves = np.zeros((none, _FEATURES)), np.zeros((none + 1, none + 1))
    weights[:, 0] = -2.0
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(epochs):
        for region, gold in data:
            grad_w, grad_m = _gradient(region, gold, weights, moves)
            grad_w -= ridge * weights
            grad_m -= ridge * moves
            seen_w += grad_w ** 2
            seen_m += grad_m ** 2
            weights += rate * grad_w / np.sqrt(seen_w)
            moves += rate * grad_m / np.sqrt(seen_m)
    return Field(weights.tolist(), moves.tolist())


def _gradient(region: Region, gold, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of one region: observed minus expected features and moves."""
    none, size = len(KINDS), len(region.ends)
    own = [[(i, f, weights[:, f].sum(axis=1)) for i, f in segments] for segments in region.segments]
    ahead = np.full((size + 1, none + 1), -np.inf)
    ahead[0, none] = 0.0
    for t in range(1, size + 1):
        ahead[t, none] = np.logaddexp.reduce(ahead[t - 1] + moves[:, none])
        for i, _, score in own[t]:
            into = np.logaddexp.reduce(ahead[i][:, None] + moves[:, :none], axis=0) + score
            ahead[t, :none] = np.logaddexp(ahead[t, :none], into)
    behind = np.full((size + 1, none + 1), -np.inf)
    behind[size] = 0.0
    for t in range(size, 0, -1):
        behind[t - 1] = np.logaddexp(behind[t - 1], moves[:, none] + behind[t, none])
        for i, _, score in own[t]:
            out = np.logaddexp.reduce(moves[:, :none] + score + behind[t, :none], axis=1)
            behind[i] = np.logaddexp(behind[i], out)
    total = np.logaddexp.reduce(ahead[size])
    grad_w, grad_m = np.zeros_like(weights), np.zeros_like(moves)
    for t in range(1, size + 1):
        grad_m[:, none] -= np.exp(ahead[t - 1] + moves[:, none] + behind[t, none] - total)
        for i, features, score in own[t]:
            each = np.exp(ahead[i][:, None] + moves[:, :none] + score + behind[t, :none] - total)
            grad_m[:, :none] -= each
            grad_w[:, features] -= each.sum(axis=0)[:, None]
    labels, t, last = {first: (kind, stop) for first, kind, stop in gold}, 0, none
    while t < size:
        kind, stop = labels.get(t, (none, t + 1))
        grad_m[last, kind] += 1
        if kind < none:
            features = next(f for i, f in region.segments[stop] if i == t)
            grad_w[kind, features] += 1
        t, last = stop, kind
    return grad_w, grad_m


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_regions: int = SAMPLE_REGIONS,
          sample_chars: int = SAMPLE_CHARS) -> Field:
    """Fit the field to the base spans of a sample: the documents with the smallest hashes of text and doc_id.

    At most `sample_docs` documents are looked at and `sample_regions` regions reach the driver. Regions of more than
    `sample_chars` characters are left out of the fit, not out of the search.
    Without any such region the field adds nothing.
    """
    sample = docs.select(F.col("text").cast("string"), "doc_id").filter(F.col("text").rlike("[0-9@]"))
    sample = smallest(sample, F.struct("text", "doc_id"), sample_docs).select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in steps(batch.column(0)):
                found = [text[begin:end] for text in texts for begin, end in _regions(text)
                         if end - begin <= sample_chars]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["region"])

    return fit([row[0] for row in sample.mapInArrow(cut, "region string").limit(sample_regions).collect()])


_SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(text: Column, field: Field) -> Column:
    """All spans in code points, end exclusive, by start and then kind; null and empty texts have none."""
    @F.arrow_udf(_SPAN)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [all_spans(x, field) for texts in steps(column) for x in texts]
            flat = [span for row in found for span in row]
            fields = pa.StructArray.from_arrays(
                [pa.array([KINDS[x.kind] for x in flat], pa.string()), pa.array([x.start for x in flat], pa.int32()),
                 pa.array([x.end for x in flat], pa.int32()), pa.array([x.base for x in flat], pa.bool_())],
                names=["kind", "start", "end", "base"])
            ends = np.concatenate([[0], np.cumsum([len(row) for row in found], dtype=np.int64)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), fields)

    return spans(text.cast("string"))


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and `spans` of every row, by a field fitted to these documents unless one is given.

    Null and empty texts have no spans; rows of equal or null doc_id stay rows of their own; other columns are not
    looked at.
    """
    model = train(docs) if field is None else field
    return docs.select("doc_id", find(F.col("text"), model).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows with every span in `text` replaced by its kind in brackets, and `n_chars` made to fit.

    Of spans that overlap, the one that begins first (then by kind) names the whole stretch. All other columns, and
    null texts, stay as they are.
    """
    model = train(docs) if field is None else field

    @F.arrow_udf("string")
    def replaced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = [_replace(x, all_spans(x, model)) for some in steps(column) for x in some]
            yield pa.array([x if valid else None for x, valid in zip(texts, column.is_valid().to_pylist(), strict=True)],
                           pa.string())

    clean = docs.withColumn("text", replaced(F.col("text").cast("string")))
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if (
        "n_chars" in docs.columns) else clean


def _replace(text: str, spans: list[Span]) -> str:
    parts, done = [], 0
    for span in spans:
        if span.start >= done:
            parts += [text[done:span.start], f"[{KINDS[span.kind].upper()}]"]
        done = max(done, span.end)
    return "".join([*parts, text[done:]])
