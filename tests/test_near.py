"""Near-duplicate groups follow the rule that the order of rows sets."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from filecensus.functions.vectors import cosine
from filecensus.operators import near
from filecensus.operators.near import embed_texts, near_duplicates, near_members

pytestmark = pytest.mark.usefixtures("interpreted")


def expected(rows, threshold):
    """From the matrix of all products: a row is an anchor iff no earlier anchor reaches it."""
    ordered = sorted((o, v) for o, v in rows if any(v))
    heads = np.array([o for o, _ in ordered])
    close = np.zeros((len(ordered), len(ordered)), dtype=bool)
    for width in {len(v) for _, v in ordered}:
        at = [i for i, (_, v) in enumerate(ordered) if len(v) == width]
        matrix = np.array([ordered[i][1] for i in at], dtype=float)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        close[np.ix_(at, at)] = matrix @ matrix.T >= threshold - (1e-9 if threshold == 1 else 0)
    anchor = np.zeros(len(ordered), dtype=bool)
    found = {}
    for i in range(len(ordered)):
        reached = np.flatnonzero(anchor[:i] & close[i, :i])
        anchor[i] = not len(reached)
        if len(reached):
            found[int(heads[i])] = int(heads[reached[0]])
    return found


def members(spark, rows, threshold, **options):
    frame = spark.createDataFrame([(o, f"p/{o}.txt", o + 1, v) for o, v in rows],
                                  "ordinal bigint, rel_path string, size bigint, embedding array<double>")
    return near_members(frame.repartition(3), threshold, **options)


def test_chain_is_not_merged(spark):
    angle = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    rows = [(0, angle(0)), (1, angle(15)), (2, angle(30)), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0]), (5, [])]
    got = members(spark, rows, 0.95)
    assert [(r["ordinal"], r["anchor"]) for r in got.collect()] == [(1, 0)]
    groups = near_duplicates(got).collect()
    assert [tuple(g) for g in groups] == [("near", "p/0.txt", "p/0.txt", 1, 2)]


@pytest.mark.parametrize("seed, threshold, rows_a_cell", [(0, 0.95, 12), (1, 0.8, 40), (2, 1.0, 12), (3, 0.95, 1000)])
def test_random_vectors(spark, seed, threshold, rows_a_cell):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)]
    rows = []
    for o in rng.sample(range(1000), 150):
        if o % 3 == 0:
            vector = centres[0][:]                       # a third of all rows are one vector
        else:
            vector = [x + rng.gauss(0, 0.35) for x in rng.choice(centres)]
        rows.append((o, vector if o % 17 else vector + [0.5]))
    got = {r["ordinal"]: r["anchor"] for r in members(spark, rows, threshold, hot_rows=20, block=8,
                                                             rows_a_cell=rows_a_cell).collect()}
    assert got == expected(rows, threshold)


def clustered(rng, clusters, size, width=6, spread=0.02):
    centres = rng.normal(size=(clusters, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.repeat(centres, size, axis=0) + rng.normal(size=(clusters * size, width)) * spread


def work(spark, vectors, threshold, rows_a_cell):
    """Pairs that are compared for each row, and the largest number of rows at home in a cell."""
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "head bigint, embedding array<double>")
    cells = near._cells(frame, threshold, rows_a_cell).groupBy("width", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("home").alias("at_home"))
    pairs, most, homes = cells.agg(F.sum(F.col("n") * F.col("at_home")), F.max("at_home"), F.sum("at_home")).first()
    assert homes == len(vectors)
    return pairs / len(vectors), most


def test_work_for_each_row_does_not_grow_with_rows(spark):
    rng = np.random.default_rng(1)
    few, most = work(spark, clustered(rng, 500, 10), 0.99, 200)
    many, most_of_many = work(spark, clustered(rng, 2000, 10), 0.99, 200)
    assert max(most, most_of_many) <= 200 and many <= 1.5 * few


def test_crowds_of_near_copies(spark):
    """A third of all rows lie close together, so their cell cannot be split; the others are far from each other."""
    rng = np.random.default_rng(2)
    vectors = np.concatenate([clustered(rng, 1, 150, 8, 0.001), clustered(rng, 100, 3, 8, 0.02)])
    order = rng.permutation(len(vectors))
    rows = [(int(o), vectors[i].tolist()) for o, i in enumerate(order)]
    got = {r["ordinal"]: r["anchor"] for r in members(spark, rows, 0.97, block=16, rows_a_cell=32).collect()}
    assert got == expected(rows, 0.97)


def test_cells_on_their_own_take_no_rounds(spark, monkeypatch):
    def none(*_):
        raise AssertionError("no rounds were needed")

    monkeypatch.setattr(near, "_rounds", none)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(4000, 64))
    assert members(spark, [(i, v.tolist()) for i, v in enumerate(vectors)], 0.95).collect() == []


def test_rows_that_cannot_be_parted_take_no_rounds(spark, monkeypatch):
    """Directions at random under a low threshold: no split is worth it, but few anchors claim all other rows."""
    def none(*_):
        raise AssertionError("no rounds were needed")

    monkeypatch.setattr(near, "_rounds", none)
    vectors = np.random.default_rng(4).normal(size=(1200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = {r["ordinal"]: r["anchor"] for r in members(spark, rows, 0.6, block=64, rows_a_cell=300).collect()}
    assert got == expected(rows, 0.6)


def test_splits_are_weighed_before_rows_are_dealt(spark, monkeypatch):
    dealt = []
    deal = near._dealt
    monkeypatch.setattr(near, "_dealt", lambda rows, pivots, reach, chunk, told: dealt.append((told, frame := deal(
        rows, pivots, reach, chunk, told))) or frame)
    vectors = np.random.default_rng(5).normal(size=(600, 8))
    _, most = work(spark, vectors, 0.4, 100)
    assert most == 600
    assert sum(frame.count() for told, frame in dealt if told is near._visits) == 0


def test_tiles_import_what_they_use(monkeypatch):
    """A worker that has run nothing else yet compares blocks, too."""
    taken = []

    class Tiles:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, function, _):
            taken.append(function)

    def judge(own, others, close, before):
        return pa.table({"n": [own.num_rows + others.num_rows]})

    judge.columns = [("n", pa.int64())]
    monkeypatch.setattr(near, "_tiles", lambda *_: Tiles())
    near._compared(None, 8, judge, "n bigint")
    assert b"pyarrow.compute" in cloudpickle.dumps(taken[0])


def test_cosine(spark):
    pairs = [([1.0, 0.0], [1.0, 1.0]), ([], [1.0]), ([1.0], [1.0, 2.0]), ([0.0], [0.0]), ([3.0, 4.0], [3.0, 4.0])]
    frame = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    got = [r[0] for r in frame.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 0.0, 0.0, 0.0, 1.0])


def test_the_model_runs_once_per_file(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: [float(len(t)), 1.0 + len(t) % 3] if t else None)

    files = spark.createDataFrame([(i, f"p/{i}.txt", 1, "x" * (i % 40)) for i in range(200)],
                                  "ordinal bigint, rel_path string, size bigint, text string")
    embedded = embed_texts(files, embed)
    groups = near_duplicates(near_members(embedded, 0.95))
    assert groups.count() > 0 and embedded.count() == 195
    assert seen.value == 200
    short = embed_texts(files, embed, max_chars=7)
    assert max(r["embedding"][0] for r in short.collect()) == 7.0


def test_thresholds(spark):
    for threshold in (0.0, 1.01):
        with pytest.raises(ValueError):
            members(spark, [(0, [1.0])], threshold)
