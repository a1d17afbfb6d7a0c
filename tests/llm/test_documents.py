"""Sharding, decontamination, personal data and quality on odd documents, against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_llm import CLASHING, as_docs, rows_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from filecensus.llm import decontaminate, pii, quality, sharding


# -- sharding ----------------------------------------------------------------------------------------------------

def draw(key, path, kids):
    def score(name, weight):
        drawn = xxhash.xxh64_intdigest(f"{path}/{name}".encode(), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
        return -np.log(((drawn >> 11) + 0.5) / 2.0 ** 53) / weight

    return min(kids, key=lambda name: score(name, kids[name]))


def descend(key, tree):
    path, rows = "", list(tree)
    for level in range(3):
        kids = Counter()
        for leaf in rows:
            kids[str(leaf[level])] += leaf[3]
        name = draw(key, path, {k: w for k, w in kids.items() if w})
        path, rows = f"{path}/{name}", [leaf for leaf in rows if str(leaf[level]) == name]
    return rows[0][2]


def test_shards_follow_the_draws(spark):
    tree = [("a", "r", 0, 1.0), ("a", "s", 1, 2.5), ("b", "r", 2, 0.5), ("b", "r", 3, 0.0), ("c", "t", 4, 3.0)]
    rows = spark.range(400).withColumn("key", F.concat(F.lit("k"), F.col("id")))
    for row in sharding.place(rows, F.col("key"), tree).collect():
        assert row.shard == descend(f"+{row.key}", tree)


def test_weights_are_kept_and_moves_confined(spark):
    tree = [("a", "r", 0, 1.0), ("a", "s", 1, 2.0), ("b", "r", 2, 3.0), ("b", "s", 3, 2.0)]
    heavier = [(*leaf[:3], leaf[3] + 2 * (leaf[2] == 1)) for leaf in tree]
    rows = spark.range(20_000)
    both = sharding.place(sharding.place(rows, F.col("id"), tree), F.col("id"), heavier, "new_")
    moved = Counter((row.shard, row.new_shard) for row in both.collect())
    counts = Counter()
    for (old, _), n in moved.items():
        counts[old] += n
    for leaf in tree:
        assert abs(counts[leaf[2]] / 20_000 - leaf[3] / 8) < 0.02
    # Rows only enter the heavier region, and in it only the heavier rack.
    assert all(old == new or new in (0, 1) for old, new in moved)
    assert (1, 0) not in moved and not {(2, 3), (3, 2)} & set(moved)


def test_documents_in_shards(docs, no_docs):
    found = sharding.shard_documents(docs, 4).collect()
    texts = {(row.doc_id, zlib.crc32((row.text or "").encode()), len((row.text or "").encode()) + 1)
             for row in docs.collect()}
    assert {(row.doc_id, row.text_crc32, row.size) for row in found} == texts and len(found) == docs.count()
    for shard in range(4):
        slots = [row.slot for row in found if row.shard == shard]
        assert sorted(slots) == list(range(len(slots)))
    for row in found:
        key = "-" if row.doc_id is None else f"+{row.doc_id}"
        assert row.law == "key" and row.shard == descend(key, sharding.even_tree(4))
        assert row.grown_shard in (row.shard, 4)
    assert sharding.shard_documents(no_docs).collect() == []


def test_bad_trees():
    for tree in ([], [("a", "r", 0, 1.0)] * 2, [("a", "r", 0, -1.0)], [("a", "r", 0, 0.0)], [("a", "r", 0, float("nan"))]):
        with pytest.raises(ValueError):
            sharding._children(tree)


# -- decontamination ---------------------------------------------------------------------------------------------

def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contaminated(texts, items, width=13):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(width, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            windows.setdefault(tuple(own[i:i + size]), set()).add("null" if item is None else str(item))
    found = []
    for text in texts:
        own, hit, names = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(own) - size + 1):
                if at := windows.get(tuple(own[i:i + size])):
                    names |= at
                    hit.update(range(i, i + size))
        joined = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found.append((len(own), len(hit), len(names), joined, bool(hit) and 20 * len(hit) >= len(own)))
    return found


def test_decontamination(spark, docs, no_docs):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "Ümlaut", "éa", "x1", "the", "the", "of"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([1, 2, 3, 5, 8, 12, 13, 14, 30]))) for i in range(12)]
    items += [(3, items[5][1]), (None, items[7][1] + " x1"), (90, None), (91, "..."), (10, items[2][1])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, words string")
    held = [(t or "")[:90].replace(" ", "--") for _, t in items]
    texts = [prose(40) + "! " + t + "\n" + prose(rng.randint(0, 60)) for t in held] + held + [None, "", "...", "of"]
    texts += [row.text for row in docs.collect()]
    table = as_docs(spark, texts, extra=CLASHING)
    found = decontaminate.contamination(table, benchmark)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(found, "doc_id", *columns) == sorted(
        ((i, *row) for i, row in enumerate(contaminated(texts, items))), key=repr)
    clean = decontaminate.remove_contaminated(table, benchmark)
    assert clean.columns == table.columns
    assert rows_of(clean, "doc_id") == sorted(
        ((i,) for i, row in enumerate(contaminated(texts, items)) if not row[-1]), key=repr)
    assert decontaminate.contamination(no_docs, benchmark).collect() == []
    nothing = decontaminate.contamination(docs, benchmark.limit(0)).collect()
    assert len(nothing) == docs.count() and not any(row.contaminated or row.n_hit for row in nothing)


def test_ids_do_not_run_on_into_texts(spark):
    """Rows whose id and text read alike one behind the other are still two rows."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, other = prose(14), prose(14)
    benchmark = spark.createDataFrame([(0, passage)], "item_id bigint, text string")
    rows = [("a", f"{passage}\n{other}"), (f"a\n{passage}", other), ("+a", passage), ("", passage), (None, passage),
            (None, other), ("1:", other), ("1", f":{other} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = decontaminate.contamination(docs, benchmark)
    expected = contaminated([text for _, text in rows], [(0, passage)])
    assert rows_of(found, "doc_id", "n_words", "n_hit", "contaminated") == sorted(
        ((name, row[0], row[1], row[-1]) for (name, _), row in zip(rows, expected, strict=True)), key=repr)
    assert rows_of(decontaminate.remove_contaminated(docs, benchmark), "doc_id") == sorted(
        ((name,) for (name, _), row in zip(rows, expected, strict=True) if not row[-1]), key=repr)


def test_fingerprints_meet_for_every_shared_window(spark):
    rng = random.Random(8)
    shared = [rng.choice("abc") for _ in range(13)]
    for _ in range(3):
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 30))] + shared + [rng.choice("abcd") for _ in range(9)]
        frame = spark.createDataFrame([(shared, text)], "a array<string>, b array<string>")
        row = frame.select(decontaminate.fingerprints(F.col("a"), 13).alias("a"),
                           decontaminate.fingerprints(F.col("b"), 13).alias("b")).first()
        assert len(row.a) == 1 and row.a[0] in row.b


# -- personal data -----------------------------------------------------------------------------------------------

def base(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda x: re.sub("[^0-9]", "", x)

    def sound(kind, x):
        if kind == 1:
            return all(int(part) <= 255 for part in x.split("."))
        if kind == 2:
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits(x)))]
            return 12 <= len(digits(x)) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
        return kind == 0 or 9 <= len(digits(x)) <= 15

    return sorted((m.start(), kind, m.end(), True) for kind, pattern in enumerate(patterns)
                  for m in re.finditer(pattern, text) if sound(kind, m[0]))


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text("a1@.+-( )9é%"), st.text(), st.lists(st.sampled_from(
    ["a.b@c.de", "@", "10.0.0.1", "256.1.1.1", "4111 1111 1111 1111", "+1 (843) 555-7672", " ", "-", ".", "7"])).map("".join)))
def test_base_spans(text):
    assert [tuple(span) for span in pii.base_spans(text)] == base(text)


def test_very_long_numbers():
    zeros = "0" * 5000
    for text in (f"1.2.3.{zeros}1", f"1.2.3.{zeros}", f"{zeros}256.1.1.1", f"1.2.3.{'9' * 5000}", f"mail a@b.c {zeros} 10.0.0.1"):
        found = [(text[s.start:s.end].replace(zeros, "Z"), s.kind) for s in pii.base_spans(text) if s.kind == 1]
        expected = {"1.2.3.Z1": 1, "1.2.3.Z": 1, "10.0.0.1": 1}
        assert all(expected.get(x) == kind for x, kind in found)
        assert len(found) == (0 if "256" in text or "999" in text else 1)


def personal(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([f"ann.{digits(2)}@mail{digits(1)}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                       "4111111111111111", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", digits(5), digits(16), "12:30", "3.14"])


@pytest.fixture(scope="module")
def field():
    rng = random.Random(6)
    return pii.fit([f"write to {personal(rng)} about it {rng.random():.3f} or {personal(rng)} ok" for _ in range(400)])


def test_field_learns_the_base_and_adds_to_it(field):
    rng = random.Random(7)
    for _ in range(200):
        text = f"from here to {personal(rng)} there"
        own = {(start, kind, end) for start, kind, end, _ in base(text)}
        chosen = {x for begin, end in pii._regions(text) for x in field.best(text, begin, end)}
        assert chosen == own
    # The pattern for phones runs on into the address, has too many digits and gives up.
    text = "aux +1 (843) 555-7672 170.106.20.30"
    assert [(text[x.start:x.end], pii.KINDS[x.kind], x.base) for x in pii.all_spans(text, field)] == [
        ("+1 (843) 555-7672", "phone", False), ("170.106.20.30", "ip", True)]
    for clean in ("in 2024 we had 12 of 300 cases", "", "a@b", "no digits at all", "1 2 3 4", "@ @ @"):
        assert pii.all_spans(clean, field) == []


def test_gradient_is_that_of_the_likelihood():
    text = "to +1 (213) 555-0199 or 10.0.0.1"
    region = pii.read_region(text, 0, len(text))
    gold = pii._gold(text, 0, region)
    rng = np.random.default_rng(0)
    weights, moves = rng.normal(size=(4, pii._FEATURES)) / 5, rng.normal(size=(5, 5)) / 5

    def likelihood(weights, moves):
        size, none = len(region.ends), 4
        ahead = np.full((size + 1, 5), -np.inf)
        ahead[0, none] = 0
        for t in range(1, size + 1):
            ahead[t, none] = np.logaddexp.reduce(ahead[t - 1] + moves[:, none])
            for i, f in region.segments[t]:
                for kind in range(4):
                    ahead[t, kind] = np.logaddexp(ahead[t, kind], np.logaddexp.reduce(
                        ahead[i] + moves[:, kind]) + weights[kind, f].sum())
        score, last, t, labels = 0.0, none, 0, {i: (k, j) for i, k, j in gold}
        while t < size:
            kind, stop = labels.get(t, (none, t + 1))
            score += moves[last, kind]
            if kind < none:
                score += weights[kind, next(f for i, f in region.segments[stop] if i == t)].sum()
            last, t = kind, stop
        return score - np.logaddexp.reduce(ahead[size])

    grad_w, grad_m = pii._gradient(region, gold, weights, moves)
    for grad, target in ((grad_w, weights), (grad_m, moves)):
        for place in [tuple(x) for x in rng.integers(0, target.shape, size=(12, 2))]:
            target[place] += 1e-5
            up = likelihood(weights, moves)
            target[place] -= 2e-5
            down = likelihood(weights, moves)
            target[place] += 1e-5
            assert abs((up - down) / 2e-5 - grad[place]) < 1e-4


def test_spans_and_redaction(docs, no_docs, field):
    found = pii.detect(docs, field)
    assert found.count() == docs.count()
    for row in docs.select("text", pii.find(F.col("text"), field).alias("found")).collect():
        assert [(x.start, pii.KINDS.index(x.kind), x.end, True) for x in row.found if x.base] == base(row.text or "")
    clean = pii.redact(docs, field)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for row in clean.collect():
        assert row.n_chars == (None if row.text is None else len(row.text))
        assert not base(row.text or "")
    texts = {row.text for row in clean.collect()}
    assert "mail [EMAIL] or [IP]" in texts and "call [PHONE] now" in texts and None in texts
    assert pii.detect(no_docs).collect() == [] and pii.redact(no_docs).collect() == []


# -- quality -----------------------------------------------------------------------------------------------------

def graded(seed, n):
    """(text, quality, toxic): prose, some of it spoilt in one of several ways."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for _ in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        poor, toxic = rng.random() < 0.25, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["idiot", "scum", "zzurgle", "zzurgling"]))
        if poor:
            way = rng.randrange(3)
            own = [x + "***" for x in own] if way == 0 else [x.upper() + "!!" for x in own] if way == 1 else (
                [x for x in own[:20] for _ in range(6)])
        rows.append((" ".join(own), 0 if poor else 1, int(toxic)))
    return rows


def test_quality_on_held_out_documents(spark):
    rows = graded(1, 900)
    docs = as_docs(spark, [text for text, _, _ in rows], extra=CLASHING)
    labels = spark.createDataFrame([(i, q, t) for i, (_, q, t) in enumerate(rows) if i % 2], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    judged = {row.doc_id: row for row in quality.classify(docs, labels, model).collect()}
    held = [i for i in range(len(rows)) if i % 2 == 0]
    for name, bad in (("p_poor", lambda i: rows[i][1] == 0), ("p_toxic", lambda i: rows[i][2] == 1)):
        right = sum((judged[i][name] > 0.5) == bad(i) for i in held)
        assert right / len(held) > 0.95
    assert all(row.keep == (row.p_poor <= 0.5 and row.p_toxic <= 0.5) for row in judged.values())
    kept = quality.keep_good(docs, labels, model)
    assert kept.columns == docs.columns
    assert {row.doc_id for row in kept.collect()} == {i for i, row in judged.items() if row.keep}


def test_quality_of_odd_documents(docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 0, 1), (13, 0, 0), (900, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    assert quality.classify(docs, labels).count() == docs.count()
    # Without labels nothing is known to be bad.
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.classify(no_docs, labels).collect() == []


def test_expectation_maximisation_finds_the_error_rates():
    rng = np.random.default_rng(4)
    bad = rng.random(40_000) < 0.3
    rates = [(0.9, 0.95), (0.7, 0.9), (0.6, 0.99), (0.8, 0.8)]
    votes = [np.where(rng.random(len(bad)) < 0.2, 0, np.where(
        bad, np.where(rng.random(len(bad)) < hit, 2, 1), np.where(rng.random(len(bad)) < right, 1, 2)))
        for hit, right in rates]
    votes.append(np.where(rng.random(len(bad)) < 0.95, 0, np.where(bad, 2, 1)))
    patterns = Counter(quality._codes(np.stack(votes)).tolist())
    chance, table = quality.estimate(patterns, 5)
    for k, (hit, right) in enumerate(rates):
        assert abs(table[1, k, 2] / 0.8 - hit) < 0.04 and abs(table[0, k, 1] / 0.8 - right) < 0.04


def test_expectation_maximisation_finds_wrong_labels():
    rng = np.random.default_rng(5)
    bad = rng.random(20_000) < 0.3
    said = lambda right: np.where(rng.random(len(bad)) < right, np.where(bad, 2, 1), np.where(bad, 1, 2))
    labels = np.where(rng.random(len(bad)) < 0.5, 0, said(0.85))
    codes = quality._codes(np.stack([said(0.97), said(0.95), said(0.96), labels])).tolist()
    chance, table = quality.estimate(Counter(codes), 4)
    rates = table[:, -1] / table[:, -1, 1:].sum(axis=1, keepdims=True)
    assert abs(rates[1, 2] - 0.85) < 0.03 and abs(rates[0, 1] - 0.85) < 0.03
    # The others outvote a wrong label.
    wrong = (labels > 0) & ((labels == 2) != bad)
    assert np.mean([(chance[code] > 0.5) == b for code, b in zip(codes, bad.tolist())]) > 0.97
    assert np.mean([(chance[code] > 0.5) == b for code, b, w in zip(codes, bad.tolist(), wrong) if w]) > 0.9


def test_unlabelled_documents_and_votes_reach_the_scorer(spark):
    rows = graded(2, 900)
    shouts = lambda text: text.endswith("!!")
    docs = as_docs(spark, [text for text, _, _ in rows])
    # Shouting is never labelled: only votes on unlabelled documents tell of it.
    labels = spark.createDataFrame([(i, q, t) for i, (text, q, t) in enumerate(rows) if i % 2 and not shouts(text)],
                                   "doc_id bigint, quality int, toxic int")
    judged = {row.doc_id: row.p_poor > 0.5 for row in quality.classify(docs, labels).collect()}
    assert np.mean([judged[i] for i, (text, _, _) in enumerate(rows) if shouts(text)]) > 0.9
    assert np.mean([judged[i] == (q == 0) for i, (_, q, _) in enumerate(rows)]) > 0.95


def test_fit_holds_little_besides_the_features():
    target = (np.arange(8000) % 10 == 0).astype(np.float64)
    buckets = np.random.default_rng(3).integers(1000, quality.BUCKETS, (8000, 800), dtype=np.int32)
    buckets[:, 0] = np.where(target, 300, 301)
    buckets, texts = buckets.ravel(), np.repeat(np.arange(8000, dtype=np.int32), 800)
    tracemalloc.start()
    try:
        assert quality._regress(buckets, texts, target, rounds=3)[300] > 0
        assert quality._mine(buckets, texts, target)[300]
        assert tracemalloc.get_traced_memory()[1] < 8 * len(buckets)
    finally:
        tracemalloc.stop()


def test_features_are_gathered_by_row(spark):
    rows = [(5, "b", [3]), (2, "a", []), (9, "c", [7, 8, 9]), (7, "d", [4, 1])]
    seen = spark.createDataFrame(rows, "row bigint, name string, buckets array<int>").repartition(3)
    buckets, texts, others = quality._gathered(seen)
    assert (buckets.tolist(), texts.tolist(), others["name"].to_pylist()) == ([3, 4, 1, 7, 8, 9], [1, 2, 2, 3, 3, 3], list("abdc"))
    assert [len(x) for x in quality._gathered(seen.limit(0))] == [0, 0, 0]
