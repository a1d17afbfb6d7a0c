"""Names given in rounds equal names chosen one by one."""

import itertools
import random
from pathlib import PurePosixPath

import pytest

from filecensus.operators import naming
from filecensus.operators.naming import unique_paths


def candidates(path, tag):
    """The path itself, then name__tag, name__tag_1, name__tag_2 and so on."""
    place = PurePosixPath(path)
    yield path
    for counter in itertools.chain([""], (f"_{n}" for n in itertools.count(1))):
        yield str(place.with_name(f"{place.stem}__{tag}{counter}{place.suffix}"))


def first_free(rows, taken):
    used = {p.casefold() for p in taken}
    given = {}
    for ordinal, path, tag in sorted(rows):
        given[ordinal] = next(name for name in candidates(path, tag) if name.casefold() not in used)
        used.add(given[ordinal].casefold())
    return given


def in_rounds(spark, rows, taken, chunk_rows=1_000_000, hot_rows=1_000_000):
    frame = spark.createDataFrame(rows, "ordinal bigint, path string, tag string").repartition(3)
    used = spark.createDataFrame([(p,) for p in taken], "path string") if taken else None
    named = unique_paths(frame, "path", "tag", used, "given", hot_rows=hot_rows, chunk_rows=chunk_rows)
    return {r["ordinal"]: r["given"] for r in named.collect()}


pytestmark = pytest.mark.usefixtures("interpreted")

CASES = {
    "case only": ([(0, "Report.pdf", "aa"), (1, "report.pdf", "bb")], []),
    "real name looks derived": (
        [(0, "a__X.t", "q"), (1, "a.t", "X"), (2, "a.t", "X"), (3, "A.T", "x"), (4, "a__X_1.t", "X")], []),
    "derived name comes first": ([(0, "a.t", "X"), (1, "a.t", "X"), (2, "a__X.t", "X"), (3, "a__x.T", "Y")], []),
    "equal tails": ([(0, "d/a.t", "x_1"), (1, "d/a.t", "x"), (2, "d/a.t", "x"), (3, "d/a.t", "x"), (4, "d/a.t", "x_1")], []),
    "taken run": ([(i, "q/a.t", "X") for i in range(6)], ["q/A.t", "q/a__X.t", "q/a__X_1.t", "q/a__X_3.t"]),
    "taken by odd name": ([(i, "a.b", "c.d") for i in range(4)], ["a__c.d.b", "a__c.d_2.b"]),
    "no suffix": ([(i, "x/readme", "t") for i in range(3)] + [(9, "x/readme__t", "u")], []),
    "dot file": ([(0, ".env", "t"), (1, ".ENV", "t"), (2, ".env", "s")], []),
    "sharp s": ([(0, "Straße.txt", "t"), (1, "STRASSE.TXT", "u")], []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows, taken = CASES[name]
    assert in_rounds(spark, rows, taken) == first_free(rows, taken)


@pytest.mark.parametrize("seed", range(2))
def test_random_clashes(spark, seed):
    """Few names and tags, many of them built to collide with derived names."""
    rng = random.Random(seed)
    names = ["a.t", "A.t", "a__x.t", "a__x_1.t", "a__X__y.t", "b", "b__x", "a__y.t", "a__x_1__y.t"]
    tags = ["x", "X", "y", "x_1", "x__y"]
    rows = [(i * 3, rng.choice(names), rng.choice(tags)) for i in range(60)]
    taken = rng.sample(["a.t", "a__x.t", "a__x_2.t", "b__x_1", "a__y_1.t", "zz"], rng.randint(0, 4))
    assert in_rounds(spark, rows, taken, chunk_rows=7, hot_rows=5) == first_free(rows, taken)


def test_hot_group_is_split(spark):
    """A third of all rows are one name with one tag, ahead of and behind a blocker."""
    rows = [(i, "q/copy.bin", "abc") if i % 3 == 0 else (i, f"q/{i}.bin", "z") for i in range(900)]
    rows[1] = (1, "q/copy__abc_5.bin", "z")
    rows[800] = (800, "q/copy__abc_9.bin", "z")
    assert in_rounds(spark, rows, ["q/copy__abc_2.bin"], chunk_rows=16, hot_rows=50) == first_free(
        rows, ["q/copy__abc_2.bin"])


def test_later_rounds_write_contested_groups_only(spark, monkeypatch):
    """A cascade among a few groups in a table of many: each derived name is the real name of the next."""
    cascade = [(0, "c.t", "x"), (1, "c.t", "x"), (2, "c__x.t", "y"), (3, "c__x.t", "y"), (4, "c__x__y.t", "z"),
               (5, "c__x__y.t", "z"), (6, "c__x__y__z.t", "w")]
    written, plain = [], naming.cut_lineage

    def counted(frame):
        table = plain(frame)
        written.append(table.count())
        return table

    monkeypatch.setattr(naming, "cut_lineage", counted)
    sums = []
    for others in (50, 2000):
        written.clear()
        rows = cascade + [(100 + i, f"o/{i}.t", "q") for i in range(others)]
        assert in_rounds(spark, rows, []) == first_free(rows, [])
        assert written[:2] == [len(rows)] * 2  # the keyed rows and the names of the first round
        sums.append(sum(written[2:]))
    assert sums[0] == sums[1] < 200
