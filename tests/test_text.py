"""String expressions behave like their Python counterparts."""

from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from filecensus.functions import rules, text

NAMES = ["a.txt", ".tmp", "a.", "a.tar.gz", "a..b", "..b", "noext", "x.PDF", "a b.c d", "é.ü", "a\n.b", "~$x.doc", "."]


def column(spark, values, *expressions):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(2)
    return [tuple(r)[1:] for r in frame.select("i", *expressions).orderBy("i").collect()]


def test_stem_and_suffix(spark):
    got = column(spark, NAMES, text.stem(F.col("v")), text.suffix(F.col("v")))

    def expected(name):
        i = name.rfind(".")
        return (name[:i], name[i:]) if 0 < i < len(name) - 1 else (name, "")

    assert got == [expected(n) for n in NAMES]


def test_path_parts(spark):
    paths = ["a/b/c.t", "c.t", "a/b.c/d", "x//y"]
    got = column(spark, paths, text.base_name(F.col("v")), text.parent(F.col("v")), text.depth(F.col("v")))
    assert got == [(p.rsplit("/", 1)[-1], p[: len(p) - len(p.rsplit("/", 1)[-1])], p.count("/")) for p in paths]


@pytest.mark.parametrize("name, safe", [
    ("a:b/c*?.txt", "a_b_c__.txt"), ("trailing.  ", "trailing"), ("", "unnamed"), (" . ", "unnamed"),
    ("\t\x85tab ", "_\x85tab"), ("a" * 300 + ".pdf", "a" * 176 + ".pdf"),
    ("a" * 300, "a" * 180), ("a" * 170 + "." + "b" * 21, "a" * 170),
    ("a" * 170 + "." + "b" * 20, "a" * 159 + "." + "b" * 20), ("." + "x" * 200, "." + "x" * 179),
    ("a" * 175 + "   b" * 3 + ".txt", "a" * 175 + ".txt"),
])
def test_safe_component(spark, name, safe):
    assert column(spark, [name], text.safe_component(F.col("v"))) == [(safe,)]


@pytest.mark.parametrize("name, safe", [
    (".", "unnamed"), (".a", ".a"), ("\u3000a:", "a_"), (":\u3000", "_"), ("a:b\n", "a_b_"), ("a?" * 90, "a_" * 90),
    ("a?" * 91, "a_" * 90), (" a.b. .", "a.b"), (None, None),
])
def test_safe_component_ends(spark, name, safe):
    """Only names that are too long or whose ends are cut take the long way."""
    assert column(spark, [name, "x"], text.safe_component(F.col("v"))) == [(safe,), ("x",)]


def test_strip_knows_unicode_space(spark):
    values = ["  a ", " a　", "\x1ca\x1f", "a​", "\ta b\n"]
    assert column(spark, values, text.strip(F.col("v"))) == [(v.strip(),) for v in values]


def test_fold_case_has_the_same_classes_as_casefold(spark):
    """Over all assigned letters two names fold alike exactly when Python folds them alike."""
    import unicodedata

    letters = [chr(c) for c in range(32, 0x1F000) if not 0xD800 <= c <= 0xDFFF and chr(c) != ""
               and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    got = [r[0] for r in column(spark, letters, text.fold_case(F.col("v")))]
    ours, theirs = {}, {}
    for letter, key in zip(letters, got):
        ours.setdefault(key, set()).add(letter)
        theirs.setdefault(letter.casefold(), set()).add(letter)
    a, b = {frozenset(s) for s in ours.values()}, {frozenset(s) for s in theirs.values()}
    assert a == b, (list(a - b)[:5], list(b - a)[:5])


def test_fold_case_inside_words(spark):
    words = ["ΑΣ.txt", "ας.txt", "ασ.TXT", "STRASSE", "straße", "ẞ", "Iı", "iI"]
    got = [r[0] for r in column(spark, words, text.fold_case(F.col("v")))]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (got[i] == got[j]) == (a.casefold() == b.casefold()), (a, b)


@pytest.mark.parametrize("path, expected", [
    ("x/a.jpg", "Images"), ("x/report.pdf", "Documents"), ("x/data.csv", "Spreadsheets"), ("x/weird.xyz", "Other"),
    ("x/.json", "Other"), ("x.js/a", "Other"), ("a.YML", "Code"), ("b.xml", "Data"),
])
def test_category(spark, path, expected):
    assert column(spark, [path], rules.category(F.col("v"))) == [(expected,)]


@pytest.mark.parametrize("path, size, reason", [
    ("a/.DS_Store", 5, "system"), ("a/THUMBS.db", 0, "system"), ("~$doc.docx", 9, "temporary"), ("a/.~lock.x#", 1, "temporary"),
    ("movie.CRDOWNLOAD", 9, "temporary"), ("x.part", 0, "temporary"), ("empty.txt", 0, "empty"), ("a.txt", 1, None),
    (".tmp", 1, None), ("a/icon\r", 3, "system"),
])
def test_junk(spark, path, size, reason):
    assert column(spark, [path], rules.junk_reason(F.col("v"), F.lit(size))) == [(reason,)]


def test_accounts(spark):
    got = column(spark, ["../../etc/passwd", "", None, "a" * 80], text.clean_account(F.col("v")))
    assert got == [("etcpasswd",), ("default",), ("default",), ("a" * 64,)]


def test_normal_path(spark):
    paths = ["a//b/./c", "./x", "x/", ".", "a/b", "//a"]
    got = column(spark, paths[:5], text.normal_path(F.col("v")))
    assert got == [(str(PurePosixPath(p)),) for p in paths[:5]]


def test_answer_category(spark):
    got = column(spark, ["It is CODE or images", "none", "Images."], text.answer_category(F.col("v"), ["Images", "Code"]))
    assert got == [("Images",), (None,), ("Images",)]


def test_failure_class(spark):
    rows = [
        (403, "userRateLimitExceeded", None, None, "transient"), (403, "cannotDownloadAbusiveFile", None, None, "restricted"),
        (None, None, 28, "OSError", "permanent"), (None, None, 5, "OSError", "transient"),
        (None, None, None, "IncompleteRead", "transient"), (None, None, None, "ValueError", "permanent"),
        (503, None, None, None, "transient"), (404, None, None, None, "permanent"), (None, None, None, "OSError", "transient"),
    ]
    frame = spark.createDataFrame(rows, "s int, r string, e int, x string, want string")
    got = frame.select(rules.failure_class(F.col("s"), F.col("r"), F.col("e"), F.col("x")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_measures(spark):
    from filecensus.functions import measures

    def value(column):
        return spark.range(1).select(column).first()[0]

    lit = F.lit
    assert value(measures.run_rate(lit(None).cast("double"), lit(700), lit(10.0))) == 70.0
    assert value(measures.run_rate(lit(None).cast("double"), lit(700), lit(0.0))) == 0.0
    assert value(measures.resumed_rate(lit(900), lit(400), lit(10.0))) == 50.0
    assert value(measures.resumed_rate(lit(300), lit(400), lit(10.0))) == 0.0
    assert value(measures.remaining_bytes(lit(0), lit(0), lit(300), lit(3), lit(10))) == 700.0
    assert value(measures.percent_bytes(lit(43), lit(0), lit(3), lit(10))) == 30.0
    assert value(measures.in_units(lit(5 * 1024 ** 3 // 2), measures.GIB, 0)) == 2.0
    for remaining, rate, text_ in [(7265.0, 1.0, "2h01m"), (125.0, 1.0, "2m05s"), (9.9, 1.0, "9s"), (5.0, 0.0, "?")]:
        assert value(measures.eta_text(lit(remaining), lit(rate))) == text_
