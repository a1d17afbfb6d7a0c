"""Near-duplicate texts and vectors, repeated strings, components and the pipeline, against brute force."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest_llm import CLASHING, as_docs, rows_of
from pyspark.sql import functions as F

from filecensus.llm import components, embedding_dedup, jaccard_join, joins, suffix_dedup
from filecensus.operators.scale import cut_lineage


def reach(nodes, links):
    """Smallest node that each reaches."""
    least = {node: node for node in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


# -- components --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shape", ["chain", "star", "random", "none", "loops"])
def test_components(spark, interpreted, shape):
    rng = random.Random(1)
    links = {
        "chain": [(i, i + 1) for i in range(60)], "star": [(7, i) for i in range(50)], "none": [],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], "loops": [(3, 3), (4, 5), (5, 4)],
    }[shape]
    rng.shuffle(links)
    found = components.connected(spark.createDataFrame(links, "a bigint, b bigint"))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {tuple(row) for row in found.select("node", "component").collect()} == set(reach(nodes, [
        (a, b) for a, b in links if a != b]).items())


# -- texts -------------------------------------------------------------------------------------------------------

def shingles(text):
    own = (text or "").lower().split()
    return frozenset(tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def near(texts):
    """(class, links) of each text by comparing all pairs."""
    sets = list(map(shingles, texts))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and
             len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    counts = Counter(x for link in links for x in link)
    least = reach(range(len(sets)), links)
    return [(least[i], counts[i]) for i in range(len(sets))]


def family(rng, size, length, changes):
    """A text and copies of it in which some words are changed."""
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    base = [word() for _ in range(length)]
    texts = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(length)] = word()
        texts.append(" ".join(own))
    return texts


def test_bands_reach_the_recall():
    for threshold, recall, rows in ((0.8, 0.995, 8), (0.5, 0.9, 3), (0.9, 0.999, 12)):
        bands = jaccard_join.bands_for(threshold, recall, rows)
        assert 1 - (1 - threshold ** rows) ** bands >= recall > 1 - (1 - threshold ** rows) ** (bands - 1)


def test_near_duplicate_texts(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # so that groups have several blocks
    rng = random.Random(9)
    every = [*texts, *family(rng, 60, 150, 6), *family(rng, 12, 40, 1), *family(rng, 5, 3, 0), *family(rng, 4, 2000, 9)]
    every += every[40:44]
    docs = as_docs(spark, every, extra=CLASHING).repartition(3)
    expected = near(every)
    found = jaccard_join.near_duplicates(docs)
    assert rows_of(found, "doc_id", "class_id", "n_links", "kept") == sorted(
        ((i, least, links, least == i) for i, (least, links) in enumerate(expected)), key=repr)
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == sorted(((i,) for i, (least, _) in enumerate(expected) if least == i), key=repr)


def test_near_duplicates_of_odd_ids(spark, docs, no_docs):
    found = jaccard_join.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    twins = [row for row in found if row.doc_id == 900]
    assert [row.n_links for row in twins] == [1, 1] and sum(row.kept for row in twins) == 1
    nameless = [row for row in found if row.doc_id is None]
    assert [(row.class_id, row.n_links) for row in nameless] == [(None, 1)] * 2 and sum(r.kept for r in nameless) == 1
    empty = [row for row in found if row.doc_id in (0, 1, 2, 3)]
    assert all(row.n_links == 0 and row.kept for row in empty)
    assert jaccard_join.near_duplicates(no_docs).collect() == []
    assert jaccard_join.drop_near_duplicates(no_docs).collect() == []


def test_similar_sets_by_matrix_and_one_by_one():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(400) < rng.random() * 0.25, rng.integers(0, 2**63, 400).astype(np.uint64), base))
            for _ in range(30)]
    found = jaccard_join._similar(sets, sets, np.ones((30, 30), dtype=bool), 0.8)
    for i in range(30):
        for j in range(30):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert found[i, j] == (len(a & b) / len(a | b) >= 0.8)
            one = jaccard_join._similar([sets[i]], [sets[j]], np.ones((1, 1), dtype=bool), 0.8)
            assert one[0, 0] == found[i, j]


# -- vectors -----------------------------------------------------------------------------------------------------

def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    vectors = [(centres[i % 30] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.35])).tolist() for i in range(600)]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[5], 2) for i in range(40)] + [(1100, vectors[5], 0), (1101, vectors[5], None)]
    rows += [(1200, None, 1), (1201, [], 1), (1202, [0.0] * 16, 1), (1203, [float("nan")] * 16, 1),
             (1204, [float("inf")] + [1.0] * 15, 1), (1205, [None] + [1.0] * 15, 1), (1206, [1e300] * 16, 1),
             (1207, [1e-300] * 16, 1), (1208, [1.0] * 8, 1), (1209, [2.0] * 8, 1), (7, vectors[5], 2), (None, vectors[6], 0)]
    table = spark.createDataFrame([(*row, 1, "x") for row in rows],
                                  "vec_id bigint, embedding array<double>, label int, node int, key string").repartition(4)
    units, usable = [], []
    for _, v, label in rows:
        own = np.array([np.nan if x is None else x for x in v or [np.nan]], dtype=float)
        fine = label is not None and np.isfinite(own).all() and own.any()
        usable.append(fine)
        own = own / np.abs(own).max() if fine else own
        units.append(own / np.linalg.norm(own) if fine else own)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if usable[i] and usable[j]
             and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93]
    found = embedding_dedup.near_vectors(table, pivots=(24, 24), block=64).collect()
    assert len(found) == len(rows)
    counts = Counter(x for link in links for x in link)
    got = defaultdict(list)
    for row in found:
        got[row.vec_id].append(row)
    recalled = sum(row.n_links for row in found)
    assert 0.95 * 2 * len(links) <= recalled <= 2 * len(links)
    for i, (vec_id, _, _) in enumerate(rows):
        assert all(row.n_links <= max(counts[k] for k, r in enumerate(rows) if r[0] == vec_id) for row in got[vec_id])
        if not usable[i]:
            assert [(r.n_links, r.component_id, r.kept) for r in got[vec_id]] == [(0, vec_id, True)]
    assert {r.component_id for r in found if r.vec_id in range(1000, 1040)} <= {5}
    assert [(r.n_links, r.component_id) for r in got[1206] + got[1207]] == [(1, 1206)] * 2
    assert [(r.n_links, r.component_id) for r in got[1208] + got[1209]] == [(1, 1208)] * 2
    assert all(not r.kept for r in got[None])
    assert embedding_dedup.near_vectors(table.limit(0)).collect() == []


def test_described_by_nearest_pivots():
    rng = np.random.default_rng(5)
    units = rng.normal(size=(50, 8))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    found = embedding_dedup.describe(units, units[:20], 6)
    for row, numbers in zip(units, found, strict=True):
        assert numbers.tolist() == np.argsort(-(units[:20] @ row), kind="stable")[:6].tolist()


# -- repeated strings --------------------------------------------------------------------------------------------

def cut(texts, length=200):
    """(bytes, removed, runs, kept) of each text, by looking at every string."""
    data = [(text or "").encode() for text in texts]
    seen = Counter(x[i:i + length] for x in data for i in range(len(x) - length + 1))
    found = []
    for x in data:
        covered = np.zeros(len(x) + 1, dtype=np.int64)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        gone = np.cumsum(covered)[:len(x)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        found.append((len(x), int(gone.sum()), runs, bytes(np.frombuffer(x, dtype=np.uint8)[~gone])))
    return found


def check_cut(spark, texts):
    found = suffix_dedup.remove_repeats(as_docs(spark, texts, extra=CLASHING).repartition(2))
    rows = sorted((row.doc_id, row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) for row in found.collect())
    assert rows == [(i, *row) for i, row in enumerate(cut(texts))]


def test_repeats_are_cut(spark, texts):
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("etaoin shrd") for _ in range(n))
    passages = [prose(n) for n in (199, 200, 201, 260, 450, 1500)]
    mixed = ["".join(rng.choice([prose(rng.randint(0, 300)), rng.choice(passages)]) for _ in range(4)) for _ in range(25)]
    # The same passage with one letter changed somewhere, twice in one text, at both ends, and cut short.
    long = passages[5]
    mixed += [long[:k] + "#" + long[k + 1:] for k in (0, 150, 199, 200, 201, 700, 1499)]
    mixed += [long[300:800] + prose(20) + long[500:1000], long[:250], long[-250:], "abc" * 200, "abc" * 67, prose(5000)]
    check_cut(spark, [*texts, *mixed])


@pytest.mark.parametrize("seed", range(3))
def test_repeats_over_few_letters(spark, interpreted, seed):
    rng = random.Random(seed)
    letters = ("ab", "a", "abcd")[seed]
    base = "".join(rng.choice(letters) for _ in range(700))
    texts = [base[i:i + rng.randint(150, 420)] + rng.choice(["", "z", "a"]) for i in rng.choices(range(400), k=14)]
    check_cut(spark, texts)


def test_pieces_of_long_texts_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 199, 200, 1000, 1199, 1200, 5000)]
    seen = Counter()
    for held in suffix_dedup._pieces(texts):
        data = np.frombuffer(b"".join(piece for _, _, piece in held), dtype=np.uint8)
        ends = np.cumsum([len(piece) for _, _, piece in held])
        at, first, last, _ = suffix_dedup.marks(data, ends)
        for low, high, mark in zip(first.tolist(), last.tolist(), at.tolist(), strict=True):
            k = int(np.searchsorted(ends, low, side="right"))
            i, begin, piece = held[k]
            head = int(ends[k]) - len(piece)
            for window in range(low, high + 1):
                assert window + 200 <= ends[k] and window <= mark <= window + suffix_dedup.OFFSETS - 1
                seen[i, window - head + begin] += 1
    assert seen == Counter((i, k) for i, text in enumerate(texts) for k in range(len(text) - 199))


def test_only_listed_rows_are_shuffled(spark, monkeypatch):
    rows = spark.range(0, 4000, numPartitions=3).select(F.monotonically_increasing_id().alias("id"), F.lit("x" * 50).alias("wide"))
    listed = cut_lineage(rows.filter("id % 7 = 0 OR id % 64 = 63").select("id", (F.col("id") * 2).alias("rank")))
    expected = sorted((row.id, "x" * 50, row.rank) for row in listed.collect())
    assert len(expected) > 500
    for limit in (1 << 30, 20_000, 0):  # all is broadcast, the bits are, nothing is
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
        assert sorted(map(tuple, joins.join_listed(rows, listed, "id", 48).collect())) == expected
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "join_listed", lambda *x: asked.append(x[2:]) or joins.join_listed(*x))
    asked = []
    check_cut(spark, ["ab" * 3000, "x" * 500, "a" * 300 + "b" * 300, "b" * 400 + "a" * 250] * 2 + [str(x) * 70 for x in range(100, 130)])
    assert asked == [("id", 48)] * 3


def test_spans_of_a_text_are_apart(spark):
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = prose(3000), prose(400)
    texts = [prose(50) + passage + prose(70) + other, passage + prose(90), prose(20) + other + prose(40) + "yz" * 300]
    spans = {tuple((x.start, x.end) for x in row.spans)
             for row in suffix_dedup.repeated_spans(as_docs(spark, texts)).collect()}
    # What is alike by chance beside a passage belongs to it.
    runs = sorted((found[0][0], found[0][1] - found[0][0], len(found)) for found in spans)
    assert [n for _, _, n in runs] == [1, 2, 2]
    assert all(a[1] < b[0] for found in spans for a, b in zip(found, found[1:]))


def test_repeats_of_odd_ids(docs, no_docs):
    found = suffix_dedup.remove_repeats(docs)
    assert found.count() == docs.count() and {row.n_bytes for row in found.collect() if row.doc_id == 900} == {8}
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


# -- pipeline ----------------------------------------------------------------------------------------------------

def test_stages_keep_the_columns_and_pass_odd_rows(spark, tmp_path, docs, no_docs):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")],
                          "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    for table in (docs, no_docs):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, folder)
            assert out.columns[:len(table.columns)] == table.columns or "ids" in table.columns
            if i < 4:
                assert out.schema.names == table.schema.names and out.dtypes == table.dtypes
            if i not in (0, 1, 2):
                assert out.count() == table.count()


def test_pipeline_runs_every_stage_on_what_is_left(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    left = table
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, left = left, stage(spark, left, folder)
        if i < 4:
            left = spark.createDataFrame(left.collect(), left.schema)
            assert left.columns == table.columns and 0 < left.count() <= before.count()
    rows = left.collect()
    assert all(row.round_trip and row.n_tokens == len(row.ids) for row in rows)
    run = corpus_pipeline.run(spark, folder)
    assert sorted((row.doc_id, tuple(row.ids)) for row in run.collect()) == sorted(
        (row.doc_id, tuple(row.ids)) for row in rows)
