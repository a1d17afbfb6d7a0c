"""Streams fed in several batches end where the batch queries end."""

import datetime as dt
import json
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from filecensus.operators import failures, progress
from filecensus.schemas import HEARTBEAT
from filecensus.sources.heartbeats import read_heartbeats, stream_heartbeats
from filecensus.streaming import breaker, live, replay, store, upserts

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def beats(n, seed=0):
    rng = random.Random(seed)
    return [{"account": rng.choice("ab"), "ts": (START + dt.timedelta(seconds=15 * i)).isoformat(), "done": i, "expected": 100,
             "errors": 0, "bytes_written": i * 1000, "expected_bytes": 0, "bytes_inflight": 0, "elapsed_s": 15.0 * i} for i in range(n)]


def drop(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number:04}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_status_and_sink(spark, tmp_path):
    rows, source = beats(40), tmp_path / "in"
    source.mkdir()
    latest = live.live_status(stream_heartbeats(spark, str(source)))
    seen = {}
    watch = latest.writeStream.outputMode("update").foreachBatch(
        lambda batch, _: seen.update({r["account"]: r for r in batch.collect()})).start()
    sink = live.write_heartbeats(stream_heartbeats(spark, str(source)), str(tmp_path / "table"), str(tmp_path / "check")).start()
    try:
        for i in range(4):
            drop(source, i, rows[i * 10:(i + 1) * 10])
            watch.processAllAvailable()
            sink.processAllAvailable()
    finally:
        watch.stop()
        sink.stop()
    stored = read_heartbeats(spark, str(tmp_path / "table"))
    assert stored.count() == 40
    heads = spark.createDataFrame([], "account string, count bigint, done bigint, expected_total bigint, total_bytes bigint, expected_bytes bigint")
    assert {r["account"]: r for r in progress.progress_snapshot(stored, heads).collect()} == seen


def test_throughput_drops_nothing_in_time(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    rows = [{"account": "a", "ts": (START + dt.timedelta(minutes=m)).isoformat(), "size": m} for m in (0, 3, 12, 9, 25, 300)]
    stream = spark.readStream.schema("account string, ts timestamp, size bigint").json(str(source))
    query = live.live_throughput(stream, delay="10 minutes").writeStream.outputMode("append").foreachBatch(
        lambda batch, _: out.extend(batch.collect())).start()
    try:
        for i, row in enumerate(rows):
            drop(source, i, [row])
            query.processAllAvailable()
    finally:
        query.stop()
    frame = spark.createDataFrame([("a", dt.datetime.fromisoformat(r["ts"]), r["size"]) for r in rows[:-1]], "account string, ts timestamp, size bigint")
    expected = {tuple(r) for r in progress.throughput_windows(frame).collect()}
    assert {tuple(r) for r in out} == expected


@pytest.mark.parametrize("seed", range(3))
def test_breaker_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aab"), rng.choices(["error", "success", "restricted"], [8, 1, 1])[0]) for i in range(120)]
    schema = "ordinal bigint, account string, outcome string"
    batch = spark.createDataFrame(rows, schema)
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).json(str(source))
    query = breaker.watch(stream, str(tmp_path / "out"), str(tmp_path / "check"), 5, F.floor(F.col("ordinal") / 4)).start()
    try:
        for i in range(5):
            drop(source, i, [dict(zip(("ordinal", "account", "outcome"), r)) for r in rows[i * 24:(i + 1) * 24]])
            query.processAllAvailable()
    finally:
        query.stop()
    alerts = breaker.read_alerts(spark, str(tmp_path / "out"))
    runs = failures.failure_runs(batch, 5, F.floor(F.col("ordinal") / 10)).select("account", "first_ordinal")
    assert sorted(map(tuple, alerts.collect())) == sorted(map(tuple, runs.collect()))


def test_summaries_hold_no_raw_rows(spark):
    """One account holds a third of all rows in long runs; its chunks come down to a row each, whoever is asked."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"a{i % 50}", "error" if (i // 700) % 2 and rng.random() < 0.99 else
             rng.choice(["error", "success", "restricted"])) for i in range(6000)]
    batch = spark.createDataFrame(rows, "ordinal bigint, account string, outcome string")
    found = breaker.summaries(batch, 6, F.floor(F.col("ordinal") / 500))
    assert found.groupBy("account").count().agg(F.max("count")).first()[0] <= 12
    none = spark.createDataFrame([], breaker._OPEN)
    alerts = breaker.fold(found, none, 6).select("account", F.explode("alerts"))
    runs = failures.failure_runs(batch, 6).select("account", "first_ordinal")
    assert sorted(map(tuple, alerts.collect())) == sorted(map(tuple, runs.collect()))
    plan = breaker.fold(found, none, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_store_compacts_and_repeats_safely(spark, tmp_path):
    """After n batches a reader opens few runs, whichever batches ran twice or stopped before their manifest."""
    rng, folder, rows, opened = random.Random(2), str(tmp_path / "catalog"), [], []
    schema = "ordinal bigint, file_id string, status string"
    for batch in range(18):
        some = [(len(rows) + i, f"f{rng.randrange(12)}", f"s{batch}.{i}") for i in range(rng.randint(0, 5))]
        rows += some
        frame = spark.createDataFrame(some, schema)
        upserts.merge(frame).write.parquet(f"{folder}/runs/{batch}-0-lost")  # an attempt that ended before its manifest
        assert store.commit(folder, batch, frame, upserts.merge)
        if batch % 3 == 0:
            assert not store.commit(folder, batch, frame.limit(1), upserts.merge)
        opened.append(len(store.manifests(spark, folder)[-1]["runs"]))
    assert max(opened) <= 7 and len(list((tmp_path / "catalog" / "manifests").glob("*.json"))) == 2
    last = {}
    for ordinal, file, status in rows:
        last[file] = (last.get(file, (ordinal,))[0], file, status)
    assert sorted(map(tuple, upserts.current(spark, folder).collect())) == sorted(last.values())
    assert len([p for p in (tmp_path / "catalog" / "runs").iterdir()]) <= 14


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    for folder, rows in ((0, [("a", 1), ("b", 1)]), (1, [("a", 2)]), (1, [("a", 2)])):
        spark.createDataFrame(rows, "account string, done bigint").write.mode("overwrite").parquet(f"{tmp_path}/batch={folder}")
    assert sorted(map(tuple, live.read_status(spark, str(tmp_path)).collect())) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("name", ["live_status", "live_throughput", "breaker_alerts", "live_catalog"])
def test_replayed_streams_have_batches(spark, monkeypatch, name):
    batches, run = [], replay.run
    monkeypatch.setattr(replay, "run", lambda writer: batches.append(run(writer)))
    extra = [3] if name == "breaker_alerts" else []
    assert getattr(replay, name)(spark, "/root/testdata/sf0.001", *extra).count() > 0
    assert batches[0] >= 4


@pytest.mark.parametrize("name", ["live_throughput", "breaker_alerts"])
def test_replay_of_many_shuffled_row_groups(spark, tmp_path, monkeypatch, name):
    source = Path("/root/testdata/sf0.001")
    for table in source.glob("*.parquet"):
        if table.name != "events.parquet":
            (tmp_path / table.name).symlink_to(table)
    events = pq.read_table(source / "events.parquet")
    order = random.Random(3).sample(range(events.num_rows), events.num_rows)
    pq.write_table(events.take(order), tmp_path / "events.parquet", row_group_size=100)
    extra = [3] if name == "breaker_alerts" else []
    expected = sorted(map(tuple, getattr(replay, name)(spark, str(source), *extra).collect()))
    monkeypatch.setattr(replay, "FILE_ROWS", 150, raising=False)
    batches, run = [], replay.run
    monkeypatch.setattr(replay, "run", lambda writer: batches.append(run(writer)))
    for setting in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(setting, "4k")
    try:
        got = sorted(map(tuple, getattr(replay, name)(spark, str(tmp_path), *extra).collect()))
    finally:
        for setting in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(setting)
    assert got == expected
    # As many batches as ranges of FILE_ROWS, and at most the closing event.
    ranges = -(-events.num_rows // 150)
    assert ranges <= batches[0] <= ranges + 1


def test_catalog_upserts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("ordinal bigint, file_id string, status string").json(str(source))
    query = upserts.follow(stream, str(tmp_path / "catalog"), str(tmp_path / "check")).start()
    try:
        for i, rows in enumerate([[(0, "a", "error"), (1, "b", "done")], [(2, "a", "done"), (3, "c", "error"), (4, "c", "restricted")]]):
            drop(source, i, [dict(zip(("ordinal", "file_id", "status"), r)) for r in rows])
            query.processAllAvailable()
    finally:
        query.stop()
    got = upserts.current(spark, str(tmp_path / "catalog"))
    assert sorted(map(tuple, got.collect())) == [(0, "a", "done"), (1, "b", "done"), (3, "c", "restricted")]


def test_activity_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = spark.readStream.schema(HEARTBEAT).json(str(source))
    query = live.activity(stream, 60).writeStream.outputMode("append").foreachBatch(
        lambda batch, _: out.extend(tuple(r)[:2] for r in batch.collect())).start()
    try:
        for i, (account, second) in enumerate([("a", 0), ("a", 15), ("b", 30), ("b", 100), ("b", 150), ("a", 160), ("b", 161)]):
            drop(source, i, [{"account": account, "ts": (START + dt.timedelta(seconds=second)).isoformat()}])
            query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert out.index(("a", "idle")) > out.index(("a", "live"))
    assert out.count(("a", "live")) == 2 and out.count(("b", "live")) == 2 and out.count(("b", "idle")) == 1


def test_live_activity_takes_few_batches(spark, monkeypatch):
    """Files are bounded by rows, so a large table is many of them; accounts are called once a batch."""
    folder = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, replay.live_activity(spark, folder).collect()))
    batches = []
    run = replay.run
    monkeypatch.setattr(replay, "run", lambda writer: batches.append(run(writer)))
    monkeypatch.setattr(replay, "FILE_ROWS", -(-spark.read.parquet(f"{folder}/events.parquet").count() // 15))
    assert sorted(map(tuple, replay.live_activity(spark, folder).collect())) == plain
    assert batches[0] <= replay.FILES + 1
