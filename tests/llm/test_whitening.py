"""Whitening against one dense computation."""

import math
import random

import numpy as np
import pytest

from filecensus.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def dense(vectors):
    width = max(map(len, vectors))
    grid = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors])
    n, total = len(grid), grid.sum(axis=0)
    centred = (n * grid - total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * grid - total) ** 2).sum(axis=1), centred @ axes / np.sqrt(np.maximum(values, 1e-300)), values / values.sum(), values


def compare(spark, rows, monkeypatch=None):
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    usable = [row for row in rows if row[1] is not None and all(c is not None and math.isfinite(c) for c in row[1])]
    n, deviations, whitened, explained, values = dense([row[1] for row in usable])
    components = min(8, int((values > values.max() * len(values) * np.finfo(float).eps).sum()))
    assert len(found) == len(usable) * components
    by_place = {(row.vec_id, row.component): row for row in found}
    signs = {}
    for i, (vec, *_) in enumerate(usable):
        for k in range(components):
            row = by_place[vec, k + 1]
            assert (row.n, row.deviation) == (n, deviations[i])
            assert row.explained == pytest.approx(explained[k], rel=1e-9)
            assert row.identity_error < 1e-9
            if abs(whitened[i, k]) > 1e-6:
                signs.setdefault(k, np.sign(row.whitened * whitened[i, k]))
            assert row.whitened == pytest.approx(signs.get(k, 1) * whitened[i, k], abs=1e-8)


def random_rows(rng, n, width):
    return [(i, [rng.gauss(0, 1 / (1 + k)) for k in range(width)], i % 3) for i in range(n)]


def test_random_vectors(spark):
    rows = random_rows(random.Random(1), 300, 12)
    rows += [(300, None, 1), (301, [1.0] * 11 + [None], 1), (302, [float("nan")] * 12, 1),
             (303, [float("inf")] + [0.0] * 11, 1), (304, [0.0] * 12, None)]
    compare(spark, rows)


def test_several_blocks_and_narrow_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    compare(spark, random_rows(random.Random(2), 150, 3))


def test_flat_directions_and_short_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1), 0.5, rng.gauss(0, 0.3)][:3 - (i % 7 == 0)], 0) for i in range(40)]
    compare(spark, rows)


def test_repeated_rows_keep_their_places(spark):
    rows = [(i % 5, [float(i % 5), float(i % 3)], 0) for i in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    counts = {tuple(row) for row in found.groupBy("vec_id", "component").count().collect()}
    assert counts == {(vec, component, 6) for vec in range(5) for component in (1, 2)}


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0], 1)], [(i, [1.0, 2.0], 1) for i in range(5)],
                                  [(1, [], 1), (2, [], 1)]])
def test_tables_without_variance(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.collect() == []


def test_clashing_columns_and_null_ids(spark):
    rows = [(i if i % 4 else None, [float(i), float(i * i % 7)], 0) for i in range(20)]
    table = spark.createDataFrame(rows, SCHEMA)
    extra = table.selectExpr("*", *[f"1 AS `{c}`" for c in ("x", "v", "place", "shift", "vector", "at", "n", "_slot", "_part")])
    assert sorted(map(repr, whitening.whiten(extra).select("vec_id", "component", "deviation").collect())) == sorted(
        map(repr, whitening.whiten(table).select("vec_id", "component", "deviation").collect()))
    assert whitening.whiten(extra).count() == 40
