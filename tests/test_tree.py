"""Paths, shared folders and the listing walk."""

import random

import pytest
from pyspark.sql import functions as F

from filecensus.functions.rules import FOLDER_TYPE
from filecensus.operators import scale, tree

ITEM = ("source_ordinal int, drive_id string, drive_name string, shared_with_me boolean, position bigint, id string, "
        "name string, mime_type string, parents array<string>, size string, modified_time string, owners array<string>, "
        "shortcut_target string")

pytestmark = pytest.mark.usefixtures("interpreted")


def item(source, position, id, name, parent=None, mime="text/plain", drive="My Drive", shared=False, size="1", target=None):
    parents = [parent] if parent else []
    return (source, "", drive, shared, position, id, name, mime, parents, size, "2023-01-01T00:00:00Z", ["me@x"], target)


def walk_paths(spark, rows):
    return {r["file_id"]: r["rel_path"] for r in tree.walk(spark.createDataFrame(rows, ITEM)).collect()}


def expected_paths(rows):
    """Every row's path, by walking a map from each id to its last listing and a recursion up to what was met."""
    last = {(r[0], r[5]): r for r in sorted(rows, key=lambda r: (r[0], r[4]))}

    def chain(row, met):
        up = last.get((row[0], row[8][0])) if row[8] else None
        if up is None or up[5] in met:
            return [row[6]]
        return [*chain(up, met | {up[5]}), row[6]]

    return {(r[0], r[4]): "/".join([r[2], *chain(r, {r[5]})]) for r in rows}


def test_sources_natives_and_shortcuts(spark):
    """Folders of two levels, natives with and without an export, a shortcut, and one id listed by three sources."""
    sheet, slides, form = (f"application/vnd.google-apps.{kind}" for kind in ("spreadsheet", "presentation", "form"))
    rows = [
        item(0, 0, "w", "Wells", mime=FOLDER_TYPE, drive="Field"), item(0, 1, "w2", "North: 2", "w", FOLDER_TYPE, drive="Field"),
        item(0, 2, "log", "log?.txt", "w2", drive="Field"), item(0, 3, "tab", "table", "w2", sheet, drive="Field", size=None),
        item(0, 4, "ask", "survey", "w", form, drive="Field", size=None),
        item(0, 5, "link", "to the log", "w", drive="Field", target="log"),
        item(1, 0, "talk", "talk", mime=slides, drive="Office", size=None), item(1, 1, "log", "log?.txt", drive="Office"),
        item(1, 2, "stray", "stray.bin", "w2", drive="Office"),  # its folder is another source's
        item(2, 0, "ask", "answers.csv", drive="Shared with me", shared=True),
        item(2, 1, "link", "real.txt", drive="Shared with me", shared=True),
    ]
    assert walk_paths(spark, rows) == {
        "log": "Field/Wells/North_ 2/log_.txt", "tab": "Field/Wells/North_ 2/table.xlsx", "talk": "Office/talk.pptx",
        "stray": "Office/stray.bin", "ask": "Shared with me/answers.csv", "link": "Shared with me/real.txt"}


def test_cycles_dangling_and_repeated_ids(spark):
    rows = [
        item(0, 0, "a", "A", "b", FOLDER_TYPE), item(0, 1, "b", "B", "c", FOLDER_TYPE), item(0, 2, "c", "C", "a", FOLDER_TYPE),
        item(0, 3, "f", "f.txt", "b"), item(0, 4, "tail", "T", "a", FOLDER_TYPE), item(0, 5, "g", "g.txt", "tail"),
        item(0, 6, "self", "S", "self"), item(0, 7, "lost", "l.txt", "nowhere"), item(0, 8, "loop", "L.txt", "c"),
        item(0, 9, "d", "first", None, FOLDER_TYPE), item(0, 10, "h", "h.txt", "d"), item(0, 11, "d", "last", "e", FOLDER_TYPE),
        item(0, 12, "e", "E", None, FOLDER_TYPE), item(1, 0, "k", "k.txt", "d", drive="Team"),
        item(0, 13, "x", "X1", "y"), item(0, 14, "y", "Y", "x", FOLDER_TYPE), item(0, 15, "x", "X2", None),
    ]
    frame = spark.createDataFrame(rows, ITEM)
    got = {(r["source_ordinal"], r["position"]): r["rel_path"] for r in tree.build_paths(frame, frame).collect()}
    assert got == expected_paths(rows)


@pytest.mark.parametrize("seed, hot_rows", [(0, 3), (1, 1_000_000)])
def test_random_forests(spark, seed, hot_rows):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        parent = f"n{rng.choice([0, rng.randrange(120)])}" if rng.random() < 0.9 else None
        rows.append(item(rng.randrange(2), i, f"n{rng.randrange(115)}", f"N{i}", parent, drive="D"))
    rows = [(*r[:2], f"D{r[0]}", *r[3:]) for r in rows]
    frame = spark.createDataFrame(rows, ITEM)
    got = {(r["source_ordinal"], r["position"]): r["rel_path"] for r in tree.build_paths(frame, frame, hot_rows).collect()}
    assert got == expected_paths(rows)


def test_deep_chain(spark):
    rows = [item(0, i, f"n{i}", f"{i}", f"n{i - 1}" if i else None, FOLDER_TYPE) for i in range(40)]
    frame = spark.createDataFrame(rows, ITEM)
    got = {(r["source_ordinal"], r["position"]): r["rel_path"] for r in tree.build_paths(frame, frame).collect()}
    assert got == expected_paths(rows)


@pytest.mark.parametrize("closed", [False, True])
def test_very_deep(spark, closed):
    """A chain of 3,000 steps, and a cycle of 3,000 nodes with a tail, take a dozen rounds."""
    n = 3000
    rows = [item(0, i, f"n{i}", f"{i}", f"n{i - 1}" if i else (f"n{n - 1}" if closed else None), FOLDER_TYPE) for i in range(n)]
    rows += [item(0, n, "t0", "t0", "n7", FOLDER_TYPE), item(0, n + 1, "leaf", "leaf", "t0")]
    frame = spark.createDataFrame(rows, ITEM)
    asked = frame.filter("id IN ('leaf', 'n0', 'n2999', 'n1500')")
    got = {r["id"]: r["rel_path"].split("/")[1:] for r in tree.build_paths(asked, frame).collect()}
    ring = [str(i % n) for i in range(8, 8 + n)] if closed else [str(i) for i in range(8)]
    assert got["leaf"] == [*ring, "t0", "leaf"]
    assert got["n1500"] == ([str(i % n) for i in range(1501, 1501 + n)] if closed else [str(i) for i in range(1501)])


def test_rows_without_a_parent_are_spread(spark):
    """Rows without a parent do not meet in one task, and take no path from a folder whose id is their place."""
    rows = [item(0, i, f"f{i}", f"F{i}") for i in range(400)]
    rows += [item(0, 400, "7", "Seven", mime=FOLDER_TYPE), item(0, 401, "in", "in", "7")]
    frame = spark.createDataFrame(rows, ITEM)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = tree.build_paths(frame, frame).select("id", "rel_path", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    paths = {r["id"]: r["rel_path"] for r in got}
    assert paths["f7"] == "My Drive/F7" and paths["in"] == "My Drive/Seven/in" and len(paths) == len(got) == 402
    tasks = [r["task"] for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < 300


CHILD = ITEM.replace("source_ordinal int, drive_id string, drive_name string, shared_with_me boolean", "folder_id string")


def child(folder, position, id, name, mime="text/plain"):
    return (folder, position, id, name, mime, [folder], "4", "2023-01-01T00:00:00Z", ["f@x"], None)


def test_shared_folders_are_expanded(spark):
    listed = spark.createDataFrame([
        item(0, 0, "own", "own.txt"),
        item(2, 0, "shf", "SharedAlbum", mime=FOLDER_TYPE, drive="Shared with me", shared=True),
        item(2, 1, "other", "Other", mime=FOLDER_TYPE, drive="Shared with me", shared=True),
        item(2, 2, "p9", "known.jpg", drive="Shared with me", shared=True)], ITEM)
    children = spark.createDataFrame([
        child("shf", 0, "p1", "photo1.jpg"), child("shf", 1, "sub", "SubDir", FOLDER_TYPE), child("sub", 0, "p2", "photo2.jpg"),
        child("other", 0, "back", "Back", FOLDER_TYPE), child("back", 0, "other", "Other", FOLDER_TYPE),
        child("other", 1, "p9", "known.jpg"), child("unreached", 0, "p3", "no.jpg")], CHILD)
    assert {r["file_id"] for r in tree.walk(listed, children=children).collect()} == {"own", "p1", "p2", "p9"}
    full = tree.add_shared_children(listed, children)
    added = [r["id"] for r in full.filter("position > 2").orderBy("position").collect()]
    assert added == ["back", "p1", "sub", "p2"]  # later folders first, each opened once
    paths = {r["file_id"]: r["rel_path"] for r in tree.walk(full).collect()}
    assert paths["p1"] == "Shared with me/SharedAlbum/photo1.jpg"
    assert paths["p2"] == "Shared with me/SharedAlbum/SubDir/photo2.jpg"
    assert paths["p9"] == "Shared with me/known.jpg" and "p3" not in paths


def test_a_walk_writes_additions_and_inner_nodes_only(spark, monkeypatch):
    """Rows that are listed already, and files that are nobody's parent, are not written again."""
    written, write = [], scale.cut_lineage

    def counted(frame):
        table = write(frame)
        written.append(table.count())
        return table

    monkeypatch.setattr(scale, "cut_lineage", counted)
    monkeypatch.setattr(tree, "cut_lineage", counted)
    rows = [item(0, 0, "top", "Top", mime=FOLDER_TYPE)] + [item(0, i, f"f{i}", f"F{i}", "top") for i in range(1, 300)]
    rows += [item(2, 0, "shf", "Album", mime=FOLDER_TYPE, drive="Shared with me", shared=True)]
    listed = spark.createDataFrame(rows, ITEM)
    children = spark.createDataFrame([child("shf", 0, "p1", "photo.jpg")], CHILD)
    paths = {r["file_id"]: r["rel_path"] for r in tree.walk(listed, children=children).collect()}
    assert len(paths) == 300 and paths["f9"] == "My Drive/Top/F9" and paths["p1"] == "Shared with me/Album/photo.jpg"
    assert written and max(written) < 10
