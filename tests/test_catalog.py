"""Catalog upkeep, diffs, verification and plans on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from filecensus.operators import catalog, diff, duplicates, failures, progress, tree, verify
from filecensus.plans import funnel, layout, proposal, purge
from filecensus.schemas import ENTRY
from filecensus.sources import listings, plans, snapshots

TREE = "rel_path string, size bigint, sha256 string, readable boolean"


def entries(spark, rows):
    """Rows of (file_id, rel_path, size, sha256, status[, modified_time])."""
    full = [(i, r[0], r[1].rsplit("/", 1)[-1], r[1], "text/plain", r[2], "", "My Drive", "",
             r[5] if len(r) > 5 else "2023-05-01T00:00:00Z", r[3], "", r[4], "") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ENTRY)


# A survey's files: one table kept three times, a map kept twice at equal depth, and files of their own.
SURVEY = [
    ("s1", "Survey/2021/raw/core-17.csv", 120, "c17", "done"), ("s2", "Survey/core-17.csv", 120, "c17", "done"),
    ("s3", "Backup/old/core-17 copy.csv", 120, "c17", "done"), ("s4", "Survey/map.tif", 900, "map", "done"),
    ("s5", "Backup/map.tif", 900, "map", "done"), ("s6", "Survey/readme", 33, "rd", "done"),
    ("s7", "Lab/notes.md", 70, "n1", "done"), ("s8", "Lab/Notes__s8.md", 71, "n2", "done"),
]


def tree_of(spark, rows):
    return spark.createDataFrame([(r[1], r[2], r[3], True) for r in rows], TREE)


def one(frame):
    return frame.collect()[0].asDict()


def test_counts_and_completeness(spark):
    rows = entries(spark, SURVEY + [("e", "x", 9, "", "error"), ("r", "y", 9, "", "restricted"), ("q", "z", 9, "", "odd")])
    assert one(catalog.status_counts(rows)) == {"count": 11, "done": 8, "total_bytes": 2334, "failed": 2, "restricted": 1}

    def complete(done, restricted, failed, expected):
        columns = catalog.completeness_columns(*(F.lit(v) for v in (failed, restricted, done, expected)))
        row = spark.range(1).select(columns["complete"], columns["reason"]).first()
        return tuple(row)

    assert complete(3, 0, 1, 4) == (False, "failed")
    assert complete(3, 0, 0, 4) == (False, "missing")
    assert complete(3, 1, 0, 4) == (True, "restricted")
    assert complete(3, 0, 0, 0) == (True, "unproven")
    assert complete(4, 0, 0, 4) == (True, "complete")


def test_upsert_keeps_first_place_and_last_value(spark):
    log = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "a", "z")], "ordinal bigint, file_id string, status string")
    assert sorted(map(tuple, catalog.upsert(log).collect())) == [(0, "a", "z"), (1, "b", "y")]


def test_stale_rows_are_pruned(spark):
    rows = entries(spark, [("ghost", "g", 5, "", "error"), ("gone", "h", 5, "x", "done"), ("err", "i", 5, "", "error"),
                           ("", "j", 5, "", "error"), ("lim", "k", 5, "", "restricted")])
    listed = spark.createDataFrame([("err",)], "file_id string")
    assert {r["file_id"] for r in catalog.prune_stale(rows, listed).collect()} == {"gone", "err", ""}


def test_snapshot_trap(spark):
    rows = spark.createDataFrame([("m", "_clean", True), ("m", "20240101", True), ("m", "20240201", False)],
                                 "account string, snapshot string, complete boolean")
    assert one(catalog.latest_snapshot(rows)) == {"account": "m", "snapshot": "20240201"}
    assert tuple(catalog.resume_target(rows).first()) == ("m", "20240201", "20240101")
    assert tuple(catalog.resume_target(rows, force_new=True).first()) == ("m", None, "20240101")


def test_exact_duplicates(spark):
    groups = duplicates.exact_duplicates(entries(spark, SURVEY)).collect()
    assert sorted(tuple(g) for g in groups) == [
        ("exact", "c17", "Survey/core-17.csv", 2, 240), ("exact", "map", "Backup/map.tif", 1, 900)]
    members = duplicates.duplicate_members(entries(spark, SURVEY), hot_rows=1).collect()
    assert sorted(r["duplicate"] for r in members) == [
        "Backup/old/core-17 copy.csv", "Survey/2021/raw/core-17.csv", "Survey/map.tif"]


def test_junk_wins_over_duplicate(spark):
    rows = entries(spark, [("a", "p/e1.txt", 0, "h0", "done"), ("b", "p/e2.txt", 0, "h0", "done"), ("c", "p/c.txt", 3, "h", "done")])
    got = one(proposal.proposal_summary(proposal.classify(rows)))
    assert (got["junk_files"], got["dupe_files"], got["clean_files"], got["total_files"]) == (2, 0, 1, 3)


def test_orphans_of_a_junk_primary(spark):
    rows = entries(spark, [("x", "x.tmp", 5, "h", "done"), ("y", "deep/y.pdf", 5, "h", "done")])
    assert [r["primary"] for r in duplicates.orphaned_by_junk(rows).collect()] == ["x.tmp"]
    assert one(proposal.proposal_summary(proposal.classify(rows)))["clean_files"] == 0
    assert one(proposal.proposal_summary(proposal.classify(rows, elect_among_clean=True)))["clean_files"] == 1


def test_diff(spark):
    listing = entries(spark, SURVEY).drop("status")
    empty = entries(spark, SURVEY).limit(0)
    same = diff.incremental_diff(listing, empty, entries(spark, SURVEY))
    assert [r["outcome"] for r in same.collect()] == ["import"] * 8
    newer = listing.withColumn("size", F.when(F.col("file_id") == "s4", 7).otherwise(F.col("size")))
    changed = diff.incremental_diff(newer, empty, entries(spark, SURVEY))
    assert {r["file_id"] for r in changed.filter("outcome = 'fetch'").collect()} == {"s4"}
    damaged = tree_of(spark, SURVEY).withColumn(
        "sha256", F.when(F.col("rel_path") == "Survey/map.tif", "evil").otherwise(F.col("sha256")))
    plan = {r["file_id"]: (r["outcome"], r["fallback"]) for r in diff.import_plan(same, damaged).collect()}
    assert plan["s4"] == ("fetch", "hash_mismatch") and plan["s5"] == ("import", None)
    held = entries(spark, [("old", "LAB/Notes.MD", 4, "q", "done")])
    paths = {r["file_id"]: r["local_path"] for r in diff.assign_paths(same, held).collect()}
    assert paths["s7"] == "Lab/notes__s7.md" and paths["s8"] == "Lab/Notes__s8.md"


def test_listed_missing_sees_behind_vanished_rows(spark):
    held = entries(spark, SURVEY)
    listing = spark.createDataFrame([("s1",), ("new",)], "file_id string")
    assert [r["file_id"] for r in catalog.listed_missing(held, listing).collect()] == ["new"]


@pytest.mark.parametrize("change, outcome", [
    ({"size": 2}, "size_mismatch"), ({"sha256": "evil"}, "hash_mismatch"), ({"readable": False}, "hash_mismatch"), (None, "missing")])
def test_verify_and_gate(spark, change, outcome):
    rows, good = entries(spark, SURVEY), tree_of(spark, SURVEY)
    first = F.col("rel_path") == "Survey/readme"
    bad = good.filter(~first) if change is None else good.withColumns(
        {k: F.when(first, F.lit(v)).otherwise(F.col(k)) for k, v in change.items()})
    got = {r["rel_path"]: r["outcome"] for r in verify.verify_detail(rows, bad).collect()}
    assert got.pop("Survey/readme") == outcome and set(got.values()) == {"ok"}
    gate = verify.safety_gate(rows, F.lit(8), good, bad)
    assert tuple(gate.first()) == (False, "external_not_verified")
    assert tuple(verify.safety_gate(rows, F.lit(8), bad, good).first()) == (False, "primary_not_verified")
    assert tuple(verify.safety_gate(rows, F.lit(8), good, good).first()) == (True, "verified")
    assert tuple(verify.safety_gate(rows, F.lit(9), good, good).first()) == (False, "primary_not_verified")
    assert tuple(verify.safety_gate(rows, F.lit(8), good, None).first()) == (False, "no_external_mirror")
    assert tuple(verify.safety_gate(rows, F.lit(8), good, None, require_external=False).first()) == (True, "verified")


def test_mirror_repair(spark):
    trees = spark.createDataFrame([("ext", "Survey/readme", 2), ("primary", "Survey/readme", 33)], "dest string, rel_path string, size bigint")
    plan = verify.mirror_repair_plan(entries(spark, SURVEY[5:7]), trees, ["primary", "ext"]).collect()
    assert sorted((r["rel_path"], r["dest"], r["donor"]) for r in plan if r["donor"]) == [("Survey/readme", "ext", "primary")]
    assert sorted((r["rel_path"], r["dest"]) for r in plan if not r["donor"]) == [
        ("Lab/notes.md", "ext"), ("Lab/notes.md", "primary")]


def test_capacity_on_resume_counts_what_is_left(spark):
    rows = entries(spark, SURVEY)
    required = catalog.listing_totals(rows, rows)
    assert one(required)["required_bytes"] == 0
    got = verify.capacity_check(catalog.listing_totals(rows, rows.limit(0)), [("a", 2334), ("b", 2333)], 0.0).collect()
    assert [(r["ok"], r["shortfall_bytes"]) for r in got] == [(True, 0), (False, 1)]


def plan_frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "plan_ordinal bigint, action string, src_rel string, dest_rel string")


def test_edited_plan(spark):
    rows = entries(spark, SURVEY)
    default = proposal.default_plan(proposal.classify(rows)).orderBy("ordinal").collect()
    assert [(r["action"], r["dest_rel"], r["reason"]) for r in default][:2] == [
        ("quarantine", "_quarantine/duplicates/core-17.csv", "doublon exact"), ("keep", "Spreadsheets/2023/core-17.csv", "")]
    plan = plan_frame(spark, [
        ("keep", "Survey/2021/raw/core-17.csv", "_quarantine/duplicates/core-17.csv"), ("\tSKIP ", "Survey/core-17.csv", "x.csv"),
        ("Quarantine", "Backup/map.tif", "Maps/map.tif"), (None, "Lab/notes.md", ""), ("keep", "gone.txt", "../../up"),
        ("quarantine", "Survey/readme", "first"), ("keep", "Survey/readme", "./About//readme")])
    routed = {r["src_rel"]: (r["dest_rel"], r["kind"]) for r in layout.route_with_plan(rows, plan).collect()}
    assert routed == {
        "Survey/2021/raw/core-17.csv": ("Kept/core-17.csv", "copied"), "Backup/map.tif": ("_quarantine/Maps/map.tif", "duplicate"),
        "Lab/notes.md": ("Documents/2023/notes.md", "copied"), "Survey/readme": ("About/readme", "copied")}
    assert sorted(r["rel_path"] for r in layout.unplanned_files(rows, plan).collect()) == [
        "Backup/old/core-17 copy.csv", "Lab/Notes__s8.md", "Survey/map.tif"]


@pytest.mark.parametrize("row, problem", [
    (("keep", "Survey/readme", "../../outside/evil.bin"), "bad_destination"), (("delete", "no/file", "x"), "unknown_action"),
    (("keep", "Survey/readme", "/abs"), "bad_destination"), (("  ", "Survey/readme", "x"), "unknown_action"),
    (("keep", "Survey/readme", "   "), "bad_destination")])
def test_bad_plans_are_refused_before_routing(spark, row, problem):
    rows, plan = entries(spark, SURVEY), plan_frame(spark, [row])
    assert [r["problem"] for r in layout.plan_validation(plan, rows).collect()] == [problem]
    with pytest.raises(ValueError, match=problem):
        layout.route_with_plan(rows, plan)


def test_target_must_lie_outside_the_source():
    layout.check_roots("/estate/a", "/estate/b")
    for target in ("/estate/a", "/estate/a/sub", "/estate"):
        with pytest.raises(ValueError):
            layout.check_roots("/estate/a", target)


def test_purge(spark):
    target = spark.createDataFrame([("_quarantine/junk/a", 3), ("Images/b", 5), ("_quarantine/x", 4)], "rel_path string, size bigint")
    gate = lambda safe: spark.createDataFrame([(safe, "why")], "safe boolean, reason string")
    plan = purge.purge_plan(target, gate(True), "/r/_clean/m", ["/r/2024/m"], True)
    assert [r["rel_path"] for r in plan.collect()] == ["_quarantine/x", "_quarantine/junk/a"]
    assert tuple(purge.purge_summary(plan).first()) == (2, 7)
    refused = [dict(gate=gate(False)), dict(confirm=False), dict(target="/r/2024/m"), dict(target="/r/2024/m/sub")]
    for change in refused:
        with pytest.raises(purge.UnsafePurge):
            purge.purge_plan(**{**dict(tree=target, gate=gate(True), target="/r/_clean/m", mirrors=["/r/2024/m"], confirm=True), **change})
    assert purge.external_mirror("/r/2024/m", "/r", "/ext") == "/ext/2024/m"
    with pytest.raises(purge.UnsafePurge):
        purge.external_mirror("/elsewhere/2024", "/r", "/ext")


def test_failure_runs(spark):
    outcomes = ["error"] * 6 + ["restricted"] + ["error"] * 5 + ["success"] + ["error"] * 9
    rows = spark.createDataFrame([(i, "m", o) for i, o in enumerate(outcomes)], "ordinal bigint, account string, outcome string")
    got = failures.failure_runs(rows, 10, F.floor(F.col("ordinal") / 4)).collect()
    assert [tuple(r) for r in got] == [("m", 11, 0, 11)]


BEAT = ("account string, ts timestamp, done bigint, expected bigint, errors bigint, bytes_written bigint, "
        "expected_bytes bigint, bytes_inflight bigint, elapsed_s double, rate_bps double")
HEAD = "account string, count bigint, done bigint, expected_total bigint, total_bytes bigint, expected_bytes bigint"


def test_progress(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, 12)
    beats = spark.createDataFrame([
        ("live", at, 1, 10, 0, 5, 0, 0, 1.0, None), ("live", at + dt.timedelta(seconds=15), 7, 10, 1, 700, 0, 0, 10.0, None),
        ("big", at, 10, 100, 0, 40_000_000_000, 100_000_000_000, 3_000_000_000, 100.0, 430_000_000.0)], BEAT)
    heads = spark.createDataFrame([("old", 5, 3, 10, 300, 0), ("live", 9, 9, 9, 9, 9)], HEAD)
    got = {r["account"]: r for r in progress.progress_snapshot(beats, heads).collect()}
    assert (got["old"]["pct"], got["old"]["bytes_written"], got["old"]["source"], got["old"]["errors"]) == (30.0, 300, "manifest", 2)
    assert (got["live"]["done"], got["live"]["rate_bps"], got["live"]["source"]) == (7, 70.0, "heartbeat")
    big = got["big"]
    assert (big["effective_bytes"], big["pct_bytes"], big["remaining_bytes"], big["eta"]) == (
        43_000_000_000, 43.0, 57_000_000_000.0, "2m12s")
    states = progress.running_state(beats, F.lit("2024-01-01 12:01:10").cast("timestamp"))
    assert {r["account"]: r["state"] for r in states.collect()} == {"live": "live", "big": "idle"}


@pytest.mark.parametrize("block_rows", [80, 8192])
def test_rate_history_over_blocks(spark, block_rows):
    import datetime as dt
    import random

    rng, total, rows = random.Random(3), 0, []
    for i in range(400):
        total += rng.randrange(10_000_000)
        rows.append(("m", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=15 * i), total))
    frame = spark.createDataFrame(rows, "account string, ts timestamp, bytes_written bigint")
    chunk = F.floor(F.unix_timestamp("ts") / 300)
    got = {r["ts"]: (r["mb_s"], r["scale"]) for r in progress.rate_history(frame, block_rows=block_rows, chunk=chunk).collect()}
    rates = [0.0] + [(b[2] - a[2]) / 15 / 1e6 for a, b in zip(rows, rows[1:])]
    assert len(got) == 400
    for i, (_, ts, _) in enumerate(rows):
        assert got[ts] == pytest.approx((rates[i], max(0.1, *rates[max(0, i - 79): i + 1])), abs=1e-5)


def test_funnel(spark):
    facts = spark.createDataFrame([("a", True, False, 7, 7, 0, True, True, False), ("b", True, True, 1, 7, 0, False, False, False),
                                   ("c", False, False, 0, 0, 0, False, False, False)],
                                  "account string, has_manifest boolean, running boolean, done bigint, expected bigint, errors bigint, "
                                  "verify_clean boolean, proposed boolean, reorganized boolean")
    got = {(r["account"], r["stage"]): r["status"] for r in funnel.funnel_status(facts).collect()}
    assert [got["a", s] for s in ("backup", "verify", "propose", "reorganize")] == ["done", "done", "done", "todo"]
    assert [got["b", s] for s in ("backup", "verify", "propose", "reorganize")] == ["active", "todo", "todo", "blocked"]
    assert [got["c", s] for s in ("backup", "verify", "propose", "reorganize")] == ["todo", "blocked", "blocked", "blocked"]


# --- sources -------------------------------------------------------------------------------------

def test_snapshot_documents(spark, tmp_path):
    document = {"account": "", "expected_total": "3", "count": 3, "done": 2, "entries": [
        {"file_id": "a", "rel_path": "a.txt", "size": "12", "status": "done"}, {"file_id": "b", "size": None, "status": None},
        {"file_id": "c", "size": "x", "status": "done"}, {"file_id": "a", "rel_path": "a2.txt", "size": 13, "status": "done"}]}
    place = tmp_path / "20240101_000000" / "main"
    place.mkdir(parents=True)
    (place / "manifest.json").write_text(json.dumps(document))
    documents = snapshots.read_documents(spark, str(tmp_path / "*" / "*" / "manifest.json"))
    good, bad = snapshots.document_entries(documents)
    got = {r["file_id"]: r for r in good.collect()}
    assert (got["a"]["ordinal"], got["a"]["rel_path"], got["a"]["size"]) == (0, "a2.txt", 13)
    assert (got["b"]["size"], got["b"]["status"], got["b"]["name"]) == (0, "pending", "")
    assert (got["a"]["account"], got["a"]["snapshot"]) == ("main", "20240101_000000")
    assert [r["file_id"] for r in bad.collect()] == ["c"]
    assert one(snapshots.document_headers(documents))["expected_total"] == 3


def test_snapshot_table(spark, tmp_path):
    rows, roots = entries(spark, SURVEY), [str(tmp_path / "primary"), str(tmp_path / "ext")]
    snapshots.write_snapshot(rows, "main", "20240101", 8, 2300, roots)
    snapshots.write_snapshot(rows.limit(2), "main", "20240201", 8, 2300, roots)
    snapshots.write_snapshot(rows, "main", "20240201", 9, 2300, roots)
    for root in roots:
        assert snapshots.read_entries(spark, root, "main", "20240201").count() == 8
        heads = snapshots.read_headers(spark, root).orderBy("snapshot").collect()
        assert [(h["snapshot"], h["expected_total"], h["done"], h["total_bytes"]) for h in heads] == [
            ("20240101", 8, 8, 2334), ("20240201", 9, 8, 2334)]
    snapshots.export_snapshot(rows, "main", "20240201", 8, 2300, str(tmp_path / "out"))
    documents = snapshots.read_documents(spark, str(tmp_path / "out" / "*" / "*" / "*.json"))
    good, bad = snapshots.document_entries(documents)
    assert bad.isEmpty() and sorted(map(tuple, good.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert one(snapshots.document_headers(documents)) == {
        "account": "main", "snapshot": "20240201", "expected_total": 8, "expected_bytes": 2300, "count": 8, "done": 8,
        "total_bytes": 2334}


@pytest.mark.parametrize("size", [8, 3, 0])
def test_snapshot_documents_are_bounded(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(snapshots, "DOCUMENT_ENTRIES", 3, raising=False)
    rows = entries(spark, SURVEY).limit(size)
    snapshots.export_snapshot(rows, "main", "20240201", 8, 2300, str(tmp_path))
    files = list((tmp_path / "20240201" / "main").glob("*.json"))
    found = sorted((json.loads(file.read_text()) for file in files), key=lambda x: x["part"])
    assert [len(x["entries"]) for x in found] == {8: [3, 3, 2], 3: [3], 0: [0]}[size]
    assert [(x["part"], x["first_ordinal"]) for x in found] == [(i, 3 * i) for i in range(len(found))]
    documents = snapshots.read_documents(spark, str(tmp_path / "*" / "*" / "*.json"))
    good, bad = snapshots.document_entries(documents)
    assert bad.isEmpty() and sorted(map(tuple, good.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert one(snapshots.document_headers(documents))["count"] == size


def test_listing_pages(spark, tmp_path):
    drives = tmp_path / "drives"
    drives.mkdir()
    (drives / "page-0.json").write_text(json.dumps({"drives": [{"id": "t1", "name": "Team"}, {"id": "t2"}]}))
    sources = listings.read_sources(spark, str(drives))
    assert [r["drive_name"] for r in sources.orderBy("source_ordinal").collect()] == ["My Drive", "Team", "t2", "Shared with me"]
    for number, files in enumerate([[{"id": "a", "name": "a", "trashed": True}, {"id": "b", "size": "5", "mimeType": "text/plain"}],
                                    [{"id": "c", "parents": ["b"], "owners": [{"emailAddress": "m"}],
                                      "shortcutDetails": {"targetId": "b"}}]]):
        folder = tmp_path / "pages" / "source_ordinal=0"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"page-{number}.json").write_text(json.dumps({"files": files}))
    items = listings.read_listing(spark, str(tmp_path / "pages"), sources).orderBy("position").collect()
    assert [(r["id"], r["size"], r["shortcut_target"], r["drive_name"]) for r in items] == [
        ("b", "5", None, "My Drive"), ("c", None, "b", "My Drive")]
    assert items[1]["owners"] == ["m"] and items[0]["position"] < items[1]["position"]
    last = tmp_path / "pages" / f"source_ordinal={listings.SHARED_ORDINAL}"
    last.mkdir()
    (last / "page-4000000.json").write_text(json.dumps({"files": [{"id": "b", "name": "again"}, {"id": "d", "name": "d:1"}]}))
    files = tree.walk(listings.read_listing(spark, str(tmp_path / "pages"), sources)).orderBy("ordinal").collect()
    assert [(r["file_id"], r["rel_path"], r["size"]) for r in files] == [
        ("b", "My Drive/b", 5), ("d", "Shared with me/d_1", 0)]


def test_plan_csv(spark, tmp_path):
    path = tmp_path / "plan.csv"
    path.write_bytes(b'\xef\xbb\xbfaction,src_rel,dest_rel,reason\r\nkeep,a.jpg,"X, ""y""/a.jpg",\r\nskip,"b\nc.jpg",Z,why\r\n')
    rows = plans.read_plan(spark, str(path)).orderBy("plan_ordinal").collect()
    assert [(r["plan_ordinal"], r["action"], r["src_rel"], r["dest_rel"], r["reason"]) for r in rows] == [
        (0, "keep", "a.jpg", 'X, "y"/a.jpg', ""), (1, "skip", "b\nc.jpg", "Z", "why")]
    plan = proposal.default_plan(proposal.classify(entries(spark, SURVEY)))
    plans.write_plan(plan, str(tmp_path / "out"))
    back = plans.read_plan(spark, str(tmp_path / "out")).orderBy("plan_ordinal").collect()
    assert [r["src_rel"] for r in back] == [s[1] for s in SURVEY]
    plans.write_report(duplicates.dedup_summary(duplicates.exact_duplicates(entries(spark, SURVEY))), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).first()["duplicate_files"] == 3


def test_documents_are_read_once(spark, tmp_path):
    """Numbers that are read as text cost no reads of their own, and keep the way they are written."""
    place = tmp_path / "20240101" / "main"
    place.mkdir(parents=True)
    entries = [{"file_id": str(i), "size": i} for i in range(3000)]
    text = json.dumps({"account": "main", "entries": entries}, indent=1).replace('"size": 7\n', '"size": 7.50\n')
    (place / "1.json").write_bytes(b"\xef\xbb\xbf" + text.encode())

    def seen():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file")

    begin = seen()
    rows = snapshots.read_documents(spark, str(place)).selectExpr("snapshot", "inline(entries)").collect()
    assert seen() - begin < 4 * len(text)
    assert len(rows) == 3000 and {r["snapshot"] for r in rows} == {"20240101"}
    assert {r["file_id"]: r["size"] for r in rows}["7"] == "7.50"


def test_items_of_few_sources_are_not_shuffled(spark, tmp_path):
    items = spark.range(0, 250, numPartitions=3).selectExpr(
        "CAST(id % 2 AS INT) AS source_ordinal", "id AS position", "concat('i', id) AS id", "'a b' AS name", "'text/plain' AS mime_type",
        "CAST(array() AS ARRAY<STRING>) AS parents", "'1' AS size", "'t' AS modified_time",
        "CAST(array() AS ARRAY<STRING>) AS owners", "CAST(NULL AS STRING) AS shortcut_target")
    written = listings.dump_listing(items, str(tmp_path / "pages"), 20)
    assert sorted(map(tuple, written.collect())) == [(source, page) for source in (0, 1) for page in range(7)]
    sources = spark.createDataFrame([(0, "", "a", False), (1, "t", "b", False)],
                                    "source_ordinal int, drive_id string, drive_name string, shared_with_me boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when the sizes are not known
    try:
        read = listings.read_listing(spark, str(tmp_path / "pages"), sources)
        assert "hashpartitioning" not in read._jdf.queryExecution().executedPlan().toString()
        rows = read.orderBy("source_ordinal", "position").select("source_ordinal", "id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [tuple(row) for row in rows] == [(source, f"i{i}") for source in (0, 1) for i in range(source, 250, 2)]
