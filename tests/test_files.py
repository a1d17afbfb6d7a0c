"""Jobs over real files."""

import hashlib

import pytest

from filecensus.operators import verify
from filecensus.sources import trees


@pytest.fixture
def estate(tmp_path):
    files = {"My Drive/a b%20c+.txt": b"HELLO", "x/empty.txt": b"", ".DS_Store": b"1", "_quarantine/junk/x.tmp": b"22", "x/big.bin": b"z" * 3_000_000, "é/ü.md": "naïve \xff".encode() + b"\xfe"}
    for name, data in files.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path, files


def test_listing_and_hashing(spark, estate):
    root, files = estate
    listed = trees.list_tree(spark, str(root / "src"))
    assert {r["rel_path"]: r["size"] for r in listed.collect()} == {k: len(v) for k, v in files.items()}
    hashed = {r["rel_path"]: r["sha256"] for r in trees.hash_tree(spark, str(root / "src")).collect()}
    assert hashed == {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}
    some = spark.createDataFrame([("x/big.bin",)], "rel_path string")
    assert [r["rel_path"] for r in trees.hash_tree(spark, str(root / "src"), some).collect()] == ["x/big.bin"]


def test_only_files_of_the_right_size_are_read(spark, estate):
    root, files = estate
    rows = spark.createDataFrame([("x/big.bin", 1, "h", "done"), ("x/empty.txt", 0, "h", "done"), ("é/ü.md", 9, "", "done")],
                                 "rel_path string, size bigint, sha256 string, status string")
    assert [r["rel_path"] for r in verify.to_hash(rows, trees.list_tree(spark, str(root / "src"))).collect()] == ["x/empty.txt"]


def test_texts(spark, estate):
    root, _ = estate
    rows = spark.createDataFrame([("é/ü.md", 10), ("none.md", 1)], "rel_path string, size bigint")
    got = trees.read_texts(rows, str(root / "src")).collect()
    assert [(r["rel_path"], r["text"]) for r in got] == [("é/ü.md", "naïve \xff")]


def test_copies(spark, estate):
    root, files = estate
    routing = spark.createDataFrame(
        [(i, name, f"out/{i}.bin", len(data)) for i, (name, data) in enumerate(files.items())]
        + [(8, "lost.txt", "out/lost.txt", 1), (9, "x/big.bin", "../escape.bin", 1)],
        "ordinal bigint, src_rel string, dest_rel string, size bigint")
    done = {r["ordinal"]: r for r in trees.apply_copies(routing, str(root / "src"), str(root / "dst")).collect()}
    for i, data in enumerate(files.values()):
        assert (root / "dst" / f"out/{i}.bin").read_bytes() == data and done[i]["error"] is None
    assert done[8]["error"] and done[9]["error"] and not (root / "escape.bin").exists()
    assert not [p for p in (root / "dst").rglob(".part-*")]
    again = {r["ordinal"]: r["error"] for r in trees.apply_copies(routing, str(root / "src"), str(root / "dst")).collect()}
    assert again[0] is None


def test_texts_in_parts_are_the_texts(spark, tmp_path):
    """Cuts fall into characters of several bytes, into line ends of two, and into bytes that are no text."""
    texts = {"a.md": "naïve – 🙂\r\nend\r".encode() * 5, "b.txt": b"\xf0\x9f\x99" + "ü\r\n".encode() * 9 + b"\xc3", "c.txt": b""}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([(name, len(data)) for name, data in texts.items()] + [("none.md", 1)],
                                 "rel_path string, size bigint")
    whole = {r["rel_path"]: r["text"] for r in trees.read_texts(rows, str(tmp_path)).collect()}
    assert set(whole) == set(texts)
    for part_bytes in (1, 2, 3, 7, 1000):
        parts = trees.read_text_parts(rows, str(tmp_path), part_bytes).orderBy("rel_path", "part").collect()
        joined = {}
        for row in parts:
            joined[row["rel_path"]] = joined.get(row["rel_path"], "") + row["text"]
        assert joined == whole
        assert max(len(row["text"].encode()) for row in parts) <= part_bytes + 4


def test_a_flat_folder_is_spread(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i}").write_bytes(b"x" * (i % 7))
    listed = trees.list_tree(spark, str(tmp_path), files_per_task=20)
    assert listed.rdd.getNumPartitions() >= 15
    assert sorted((r["rel_path"], r["size"]) for r in listed.collect()) == sorted((f"f{i}", i % 7) for i in range(300))


def test_a_copy_is_logged_once_and_leaves_no_parts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "dst" / "out").mkdir(parents=True)
    (tmp_path / "src" / "a").write_bytes(b"abc")
    (tmp_path / "dst" / "out" / ".part-of-a-dead-attempt").write_bytes(b"ab")
    routing = spark.createDataFrame([(0, "a", "out/a", 3)], "ordinal bigint, src_rel string, dest_rel string, size bigint")
    log = trees.apply_copies(routing, str(tmp_path / "src"), str(tmp_path / "dst"))
    (tmp_path / "src" / "a").unlink()  # reading the log copies nothing again
    for _ in range(2):
        assert [(r["ordinal"], r["sha256"], r["error"]) for r in log.collect()] == [
            (0, hashlib.sha256(b"abc").hexdigest(), None)]
    assert [p.name for p in (tmp_path / "dst" / "out").iterdir()] == ["a"]


def test_only_mounted_folders_have_files():
    assert trees.local_path("file:///mnt/x/y") == trees.local_path("file:/mnt/x/y") == trees.local_path("/mnt/x/y") == "/mnt/x/y"
    with pytest.raises(ValueError):
        trees.local_path("hdfs://host/x")


def test_small_parts_are_handed_on_together(spark, tmp_path, monkeypatch):
    class Files:
        def mapInPandas(self, function, _):
            return function

    for i in range(50):
        (tmp_path / f"f{i}.txt").write_text("a few words " * 20)
    rows = spark.createDataFrame([(f"f{i}.txt", 240) for i in range(50)], "rel_path string, size bigint")
    monkeypatch.setattr(trees, "_spread", lambda *_: Files())
    frames = list(trees.read_text_parts(rows, str(tmp_path), 100)(iter([rows.toPandas()])))
    assert len(frames) == 1 and len(frames[0]) == 200
    whole = frames[0].groupby("rel_path")["text"].agg("".join)
    assert len(whole) == 50 and set(whole) == {"a few words " * 20}


def test_files_are_found_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def find(frames):
        for frame in frames:
            asked.add(len(frame))
            yield frame

    rows = spark.createDataFrame([(f"f{i}", i) for i in range(30)] + [("none", None)], "rel_path string, size bigint")
    spread = trees._spread(rows.mapInPandas(find, rows.schema), "rel_path")
    assert {tuple(row) for row in spread.collect()} == {tuple(row) for row in rows.collect()}
    assert asked.value == 31
    assert trees._spread(rows.limit(0), "rel_path").collect() == []
