"""A quality classifier from weak labels.

Heuristic labellers vote bad, good or nothing on every document, about two faults: poor text, and toxic text. The
given labels are one more labeller. They overlap and disagree; expectation-maximisation over the counts of all vote
patterns in the corpus estimates how each labeller votes on bad and on good documents, and with that the probability
of every pattern to be bad. These posterior labels, of a sample of all documents with and without given labels, train
a hashed linear scorer, which judges all documents.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from filecensus.llm.joins import fresh, smallest
from filecensus.llm.words import Remembered, give_back, list_array, row_sums, steps
from filecensus.operators.scale import cut_lineage

FAULTS = ("poor", "toxic")
# Documents that the scorer is fitted to, and labelled ones that signs are mined from: those of smallest hash.
SAMPLE = 8_000
BUCKETS = 1 << 18
# A word or word beginning is a sign of toxic text if so many sampled documents have it, so much more often toxic.
SIGN_DOCS = 6
SIGN_ODDS = 12.0
# Features of the scorer differ between bad and good texts by so many standard deviations.
CHANCE = 4.0
INSULTS = frozenset("idiot idiots moron morons stupid worthless pathetic disgusting trash scum loser losers "
                    "clown imbecile dumbass bastard asshole bitch whore slut retard".split())
_BAD, _GOOD, _NONE = 2, 1, 0
# Features that a step of the fit on the driver looks at.
_STEP = 1 << 18

_LETTERS = re.compile(r"[^\W\d_]+")
_STAT = ("symbols", "capitals", "shouts", "marks", "repeats", "variety", "lines", "width")
_STEPS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)


def _word(token: str) -> str:
    """The longest run of letters of a token, in lower case."""
    if token.isalpha():
        return token.lower()
    return max(_LETTERS.findall(token), key=len, default="").lower()


def token_features(token: str) -> tuple[int, ...]:
    """Shape, whether it is an insult, and the buckets of the word and of its first 4, 5 and 6 bytes.

    The shape: does it end in symbols, is it in capitals, does it end in shouting marks, is it but a mark, length.
    """
    core = token.rstrip("*&%$#@^~=+|<>/\\_")
    letters = token.isalpha() or any(map(str.isalpha, token))
    word = _word(token) if letters else ""
    raw = word.encode()
    return (len(token) - len(core) >= 2, len(word) >= 2 and token.isupper(), token.endswith(("!!", "??", "!!.", "??.")),
            not letters and not any(map(str.isdigit, token)), min(len(token), 99), word in INSULTS,
            zlib.crc32(raw, 1) % BUCKETS if raw else BUCKETS,
            *[zlib.crc32(raw[:n], n) % BUCKETS if len(raw) >= n else BUCKETS for n in (4, 5, 6)])


_WIDTH, _FIRST = 10, 6


class Reader:
    """Tokens of texts as numbers, with the features of each token remembered."""

    def __init__(self):
        self.remembered = Remembered(lambda new: list(map(token_features, new)))

    def read(self, texts: list[str]) -> Batch:
        rows = [text.split() for text in texts]
        numbers, lengths = self.remembered.number(rows)
        table = self.remembered.values[:self.remembered.used].reshape(-1, _WIDTH)
        n = np.maximum(lengths, 1)
        row = np.repeat(np.arange(len(rows)), lengths)
        same = np.zeros(len(numbers), dtype=np.int64)
        same[1:] = (numbers[1:] == numbers[:-1]) & (row[1:] == row[:-1])
        distinct = np.unique(row << 32 | numbers)
        kinds = np.bincount(distinct >> 32, minlength=len(rows))
        types = table[distinct & 0xFFFFFFFF]
        shapes = table[numbers, :5]
        shares = [row_sums(shapes[:, i], lengths) / n for i in range(5)]
        lines = [[x for x in text.split("\n") if x.strip()] for text in texts]
        repeated = np.array([1 - len(set(x)) / max(1, len(x)) for x in lines])
        return Batch(lengths, np.stack([
            *shares[:4], row_sums(same, lengths) / n, 1 - kinds / n, repeated, np.minimum(shares[4] / 20, 1)]),
            row_sums(types[:, 5], kinds), kinds, types[:, _FIRST:])


@functools.cache
def _reader() -> Reader:
    return Reader()


class Batch(NamedTuple):
    """What the labellers and the scorer see of some texts."""

    n: np.ndarray  # tokens of each text
    shares: np.ndarray  # one row for each of _STAT, from 0 to 1
    insults: np.ndarray  # different tokens that are insults
    kinds: np.ndarray  # different tokens
    buckets: np.ndarray  # of all different tokens, text by text

    def votes(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the labellers say of poor and of toxic text: one row each."""
        symbols, capitals, shouts, marks, repeats, variety, lines, width = self.shares
        enough, sure = self.n >= 15, np.ones(len(self.n), dtype=bool)

        def vote(bad: np.ndarray, good: np.ndarray, when: np.ndarray) -> np.ndarray:
            return np.where(when, np.where(bad, _BAD, np.where(good, _GOOD, _NONE)), _NONE)

        found = row_sums(signs[self.buckets].any(axis=1), self.kinds)
        poor = np.stack([
            vote(symbols + marks > 0.1, symbols + marks < 0.02, enough),
            vote((capitals > 0.4) | (shouts > 0.25), (capitals < 0.1) & (shouts < 0.02), enough),
            vote(repeats > 0.15, repeats < 0.05, enough), vote(variety > 0.65, variety < 0.45, self.n >= 60),
            vote(lines > 0.4, lines < 0.1, enough),
            vote((width < 0.1) | (width > 0.7), (width > 0.15) & (width < 0.5), enough)])
        # A text is poor in one way or another: once a fault is found, no labeller behind is asked for its own.
        faults = poor == _BAD
        poor = np.where(np.cumsum(faults, axis=0) > faults, _NONE, poor)
        toxic = np.stack([
            vote(self.insults > 0, self.insults == 0, sure), vote(found > 0, found == 0, sure),
            # Asked only where there are signs: what it says is no echo of the one before.
            vote(found * 150 > self.n, found * 150 <= self.n, found > 0)])
        return poor, toxic

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all tokens and shares in one array, and the text that each belongs to."""
        levels = np.searchsorted(_STEPS, self.shares)
        own = np.array([[zlib.crc32(f"{name} {k}".encode(), 99) % BUCKETS for k in range(len(_STEPS) + 1)]
                        for name in _STAT])
        shares = np.take_along_axis(own, levels, axis=1)
        texts = np.arange(len(self.n))
        return (np.concatenate([self.buckets.ravel(), shares.ravel(), np.full(len(texts), BUCKETS + 1)]),
                np.concatenate([np.repeat(np.repeat(texts, self.kinds), self.buckets.shape[1]),
                                np.tile(texts, len(_STAT)), texts]))

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Probabilities of each fault, one row for each row of weights."""
        buckets, texts = self.features()
        some = weights.any(axis=0)[buckets]
        pairs = np.unique(texts[some] * np.int64(BUCKETS + 2) + buckets[some])
        buckets, texts = pairs % (BUCKETS + 2), pairs // (BUCKETS + 2)
        sums = np.stack([np.bincount(texts, weights=w[buckets], minlength=len(self.n)) for w in weights])
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


class Model(NamedTuple):
    """Weights of the scorer, one row for each fault. Behind the buckets stand a zero and the constant."""

    weights: np.ndarray
    signs: np.ndarray
    tables: tuple[np.ndarray, np.ndarray]  # of `estimate`, for each fault


def _codes(votes: np.ndarray) -> np.ndarray:
    """Votes of all labellers as one number in base 3."""
    return (votes * 3 ** np.arange(len(votes))[:, None]).sum(axis=0)


def estimate(patterns: dict[int, int], labellers: int, rounds: int = 300) -> tuple[dict[int, float], np.ndarray]:
    """Expectation-maximisation over counted vote patterns.

    Returns the probability of each pattern to be bad, and table[class][labeller][vote], the classes being good and
    bad. Labellers are taken to err independently and to be right more often than not. The last one are the labels,
    which tell at first what is bad; from then on they are a labeller like the others, with an error rate of their own.
    Abstaining says nothing: labellers abstain together, on texts too short to judge.
    """
    codes = np.array(sorted(patterns), dtype=np.int64)
    counts = np.array([patterns[c] for c in codes.tolist()], dtype=np.float64)
    votes = codes[:, None] // 3 ** np.arange(labellers) % 3
    onehot = votes[:, :, None] == np.arange(3)
    weight = np.ones(labellers)
    weight[-1] = 2 * labellers  # at first the labels outvote all others
    bad, good = (votes == _BAD) @ weight, (votes == _GOOD) @ weight
    chance = np.clip((bad + 0.2) / (bad + good + 1.0), 0.02, 0.98)
    table = np.full((2, labellers, 3), 1 / 3)
    for _ in range(rounds):
        prior = np.clip((counts * chance).sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4)
        for k, weight in enumerate((counts * (1 - chance), counts * chance)):
            # A few counted votes in front: right ones more than wrong ones.
            ahead = np.array([1.0, 4.0, 0.5] if k == 0 else [1.0, 0.5, 4.0])
            seen = (weight[:, None, None] * onehot).sum(axis=0) + ahead
            table[k] = seen / seen.sum(axis=1, keepdims=True)
        cast = table[:, :, 1:] / table[:, :, 1:].sum(axis=2, keepdims=True)
        logs = [np.log(p) + (np.log(cast[k])[None] * onehot[:, :, 1:]).sum(axis=(1, 2))
                for k, p in enumerate((1 - prior, prior))]
        before, chance = chance, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(before - chance).max() < 1e-9:
            break
    return dict(zip(codes.tolist(), chance.tolist(), strict=True)), table


def _regress(buckets: np.ndarray, texts: np.ndarray, target: np.ndarray, rounds: int = 300,
             ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on hashed features, by accelerated gradient steps.

    Only features that enough texts have, and that differ between the classes far beyond chance, take part: rare
    words would but name the texts that they stand in.
    """
    found, n = np.zeros(BUCKETS + 2, dtype=np.float32), len(target)
    seen, seen_bad = _seen(buckets, texts, target)
    bad = min(max(target.sum(), 0.5), n - 0.5)
    rate, rate_bad, rate_good = seen / n, seen_bad / bad, (seen - seen_bad) / (n - bad)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1 / n) * (1 / bad + 1 / (n - bad)))
    chosen = (seen >= SIGN_DOCS) & (np.abs(rate_bad - rate_good) >= CHANCE * spread)
    chosen[BUCKETS], chosen[BUCKETS + 1] = False, True
    used = np.flatnonzero(chosen)
    inside = chosen[buckets]
    numbers = np.cumsum(chosen, dtype=np.int32) - 1
    place, texts = numbers[buckets[inside]], texts[inside]
    del inside
    # Rare features are scaled up, so that all take steps of like size.
    scale = 1 / np.sqrt(np.maximum(rate[used], 1e-3))
    each = scale[place]
    step = 4.0 / max(1.0, _largest(place, texts, each, n, len(used)))
    weights = ahead = np.zeros(len(used))
    momentum = 1.0
    for _ in range(rounds):
        score = np.bincount(texts, weights=ahead[place] * each, minlength=n)
        miss = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        slope = np.bincount(place, weights=miss[texts] * each, minlength=len(used)) / n + ridge * ahead
        fresh = ahead - step * slope
        after = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, weights, momentum = fresh + (momentum - 1) / after * (fresh - weights), fresh, after
    found[used] = weights * scale
    return found


def _largest(place: np.ndarray, texts: np.ndarray, each: np.ndarray, n: int, width: int) -> float:
    """A bound of the curvature: the largest eigenvalue of the features' second moments, by power steps."""
    vector, value = np.ones(width), 1.0
    for _ in range(20):
        vector /= max(np.linalg.norm(vector), 1e-12)
        rows = np.bincount(texts, weights=vector[place] * each, minlength=n)
        vector = np.bincount(place, weights=rows[texts] * each, minlength=width) / n
        value = np.linalg.norm(vector)
    return 1.1 * float(value)


def _seen(buckets: np.ndarray, texts: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts have each bucket, and the sum of their targets; worked out in steps, as the arrays are long."""
    seen, seen_bad = np.zeros(BUCKETS + 2, dtype=np.int64), np.zeros(BUCKETS + 2)
    for begin in range(0, len(buckets), _STEP):
        some = buckets[begin:begin + _STEP]
        seen += np.bincount(some, minlength=BUCKETS + 2)
        np.add.at(seen_bad, some, target[texts[begin:begin + _STEP]].astype(np.float64))
    return seen, seen_bad


def _mine(buckets: np.ndarray, texts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Buckets of words and beginnings that toxic sampled texts have far more often than the others."""
    seen, seen_bad = _seen(buckets, texts, toxic)
    n_bad, n = max(1.0, toxic.sum()), max(1, len(toxic))
    odds = (seen_bad + 0.5) / n_bad / ((seen - seen_bad + 0.5) / max(1.0, n - n_bad))
    signs = (seen_bad >= SIGN_DOCS) & (odds >= SIGN_ODDS)
    signs[BUCKETS:] = False
    return signs


def _known(labels: DataFrame) -> DataFrame:
    """One row for each labelled doc_id: its worst labels. Null labels say nothing."""
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))


def _label_votes(table: DataFrame, *others: str) -> DataFrame:
    """The labels themselves as one more labeller of each fault, who abstains where there is no label."""
    poor = F.when(F.col("quality") == 0, _BAD).when(F.col("quality") == 1, _GOOD).otherwise(_NONE)
    toxic = F.when(F.col("toxic") == 1, _BAD).when(F.col("toxic") == 0, _GOOD).otherwise(_NONE)
    return table.select(
        *others, (F.col("poor_votes") + poor * 3 ** 6).alias("poor"), (F.col("toxic_votes") + toxic * 3 ** 3).alias("toxic"))


def _gathered(seen: DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """All `buckets` of some rows in order of `row`, the place of the row that each belongs to, and the other columns.

    The lists are the bulk: they are copied once, a row at a time, and what Arrow held is given back.
    """
    table = seen.toArrow()
    order = pc.sort_indices(table["row"]).to_numpy()
    lists, others = table["buckets"], table.drop_columns("buckets").take(pa.array(order))
    del table
    lengths = pc.list_value_length(lists).to_numpy()
    ends = np.cumsum(lengths[order])
    begins = np.empty(len(order), dtype=np.int64)
    begins[order] = ends - lengths[order]
    buckets, row = np.empty(int(lengths.sum()), dtype=np.int32), 0
    for chunk in lists.chunks:
        values, stops = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        for begin, end in zip(stops[:-1], stops[1:], strict=True):
            buckets[begins[row]:begins[row] + end - begin] = values[begin:end]
            row += 1
    texts = np.repeat(np.arange(len(order), dtype=np.int32), lengths[order])
    lists = chunk = values = stops = None
    give_back()
    return buckets, texts, others


def _signs(source: DataFrame, known: DataFrame, sample: int) -> np.ndarray | None:
    """Signs of toxic text, mined from the labelled documents of smallest hash; None if there are none."""
    chosen = smallest(known, F.col("doc_id"), sample)  # so many rows at most are broadcast
    drawn = smallest(source.join(F.broadcast(chosen), "doc_id"), F.struct("doc_id", "text"), sample)
    drawn = cut_lineage(drawn.withColumn("row", F.monotonically_increasing_id()))
    buckets, texts, table = _gathered(drawn.select("row", "toxic", _features(F.col("text")).alias("buckets")))
    return _mine(buckets, texts, pc.fill_null(table["toxic"], 0).to_numpy()) if table.num_rows else None


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the labellers' error rates to all documents and the scorer to a sample of them, labelled or not.

    The sample are the `sample` documents of smallest hash; its targets are the probabilities that follow from the
    votes. Signs of toxic text, which two of the labellers look for, are mined from as many labelled documents. Only
    the two samples' features, one after the other, and the counts of vote patterns, which are at most 3^7 and 3^4,
    reach the driver. Null and empty texts have no tokens and get no votes. Without labelled documents nothing tells
    what a fault is, and the scorer finds none.
    """
    known = _known(labels)
    source = docs.select("doc_id", F.col("text").cast("string"))
    signs = _signs(source, known, sample)
    if signs is None:
        nothing = np.zeros((2, BUCKETS + 2), dtype=np.float32)
        nothing[:, BUCKETS + 1] = -30
        return Model(nothing, np.zeros(BUCKETS + 2, dtype=bool), (np.zeros((2, 7, 3)), np.zeros((2, 4, 3))))
    every = _label_votes(_votes(source, signs).join(known, "doc_id", "left"))
    counted = cut_lineage(every.groupBy("poor", "toxic").count()).collect()

    drawn = smallest(source, F.struct("doc_id", "text"), sample)
    drawn = cut_lineage(drawn.withColumn("row", F.monotonically_increasing_id()))
    told = known.join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id")  # no more rows than the sample
    voted = _votes(drawn, signs, "row").join(F.broadcast(told), "doc_id", "left")
    own = _label_votes(voted, "row").toArrow().sort_by("row")
    buckets, texts, _ = _gathered(drawn.select("row", _features(F.col("text")).alias("buckets")))
    tables, weights = [], []
    for name, labellers in zip(FAULTS, (7, 4), strict=True):
        codes, patterns = own[name].to_pylist(), Counter()
        for row in counted:
            patterns[row[name]] += row["count"]
        chance, table = estimate(patterns, labellers)
        tables.append(table)
        weights.append(_regress(buckets, texts, np.array([chance[code] for code in codes])))
    del buckets, texts
    give_back()  # the driver goes on to other stages
    return Model(np.stack(weights), signs, tuple(tables))


def _features(text: Column) -> Column:
    """array<int>: the different buckets of a text."""
    @F.arrow_udf("array<int>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = []
            for some in steps(column):
                buckets, texts = _reader().read(some).features()
                pairs = np.unique(texts * np.int64(BUCKETS + 2) + buckets)
                parts.append((pairs % (BUCKETS + 2), np.bincount(pairs // (BUCKETS + 2), minlength=len(some))))
            yield list_array(parts)

    return features(text)


def _votes(source: DataFrame, signs: np.ndarray, *others: str) -> DataFrame:
    """doc_id, other columns, and the vote patterns of the text: poor_votes, toxic_votes."""
    @F.arrow_udf("struct<poor:int,toxic:int>")
    def cast(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [_reader().read(texts).votes(signs) for texts in steps(column)]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate([_codes(x[k]) for x in found] or [[]]), pa.int32()) for k in (0, 1)],
                names=["poor", "toxic"])

    return source.select("doc_id", *others, cast("text").alias("votes")).select(
        "doc_id", *others, F.col("votes.poor").alias("poor_votes"), F.col("votes.toxic").alias("toxic_votes"))


def score(text: Column, model: Model) -> Column:
    """struct<poor, toxic>: probabilities that a text is poor and toxic; null counts as empty."""
    weights = model.weights

    @F.arrow_udf("struct<poor:double,toxic:double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [_reader().read(texts).score(weights) for texts in steps(column)]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate([x[k] for x in found] or [[]]), pa.float64()) for k in (0, 1)],
                names=list(FAULTS))

    return scored(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, p_poor, p_toxic and keep (neither is over one half) of every row.

    Null and empty texts are judged like texts without tokens; rows of null or repeated doc_id stay rows of their
    own; other columns are not looked at.
    """
    fitted = fit(docs, labels) if model is None else model
    faults = docs.select("doc_id", score(F.col("text"), fitted).alias("p"))
    return faults.select("doc_id", F.col("p.poor").alias("p_poor"), F.col("p.toxic").alias("p_toxic"),
                         ((F.col("p.poor") <= 0.5) & (F.col("p.toxic") <= 0.5)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows, with all their columns, that the classifier keeps."""
    fitted = fit(docs, labels) if model is None else model
    faults = fresh(docs, "_faults")
    judged = docs.withColumn(faults, score(F.col("text"), fitted))
    return judged.filter(f"`{faults}`.poor <= 0.5 AND `{faults}`.toxic <= 0.5").drop(faults)
