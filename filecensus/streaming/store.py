"""Tables that streams extend: runs of merged rows behind a manifest, compacted in tiers.

Each micro-batch adds a run. As soon as FAN runs of one tier stand at the end, they are merged into one run of the
next tier, so after n batches a reader opens O(FAN log n) runs, and a row is rewritten O(log n) times. A manifest
names the runs that count and the batch they reach; it appears by a rename, so readers and repeated batches see all
of a batch or nothing of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN = 4


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifests(spark: SparkSession, folder: str) -> list[dict]:
    """All manifests that are still there, by batch: batch, and runs as [tier, name]."""
    files, path = _files(spark, folder)
    place = path(f"{folder}/manifests")
    if not files.exists(place):
        return []
    rows = spark.read.text(f"{folder}/manifests/*.json", wholetext=True).collect()  # two of them
    return sorted((json.loads(row[0]) for row in rows), key=lambda manifest: manifest["batch"])


def last_batch(spark: SparkSession, folder: str) -> int:
    found = manifests(spark, folder)
    return found[-1]["batch"] if found else -1


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all runs that count; merging them is the caller's. None before the first batch."""
    found = manifests(spark, folder)
    return spark.read.parquet(*[f"{folder}/{name}" for _, name in found[-1]["runs"]]) if found else None


def commit(folder: str, batch_id: int, rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> bool:
    """Add the merged rows of a batch, unless it is there already. `merge` of merged runs must be that of all rows."""
    spark = rows.sparkSession
    known = manifests(spark, folder)
    before = known[-1] if known else {"batch": -1, "runs": []}
    if before["batch"] >= batch_id:
        return False

    def write(frame: DataFrame, tier: int) -> list:
        name = f"runs/{batch_id}-{tier}-{uuid.uuid4().hex}"
        frame.write.parquet(f"{folder}/{name}")
        return [tier, name]

    runs = [*before["runs"], write(merge(rows), 0)]
    while len(runs) >= FAN and len({tier for tier, _ in runs[-FAN:]}) == 1:
        some = spark.read.parquet(*[f"{folder}/{name}" for _, name in runs[-FAN:]])
        runs = [*runs[:-FAN], write(merge(some), runs[-1][0] + 1)]
    if not _publish(spark, folder, batch_id, {"batch": batch_id, "runs": runs}):
        return False
    _tidy(spark, folder, [before, {"runs": runs}], known[:-1])
    return True


def _publish(spark: SparkSession, folder: str, batch_id: int, manifest: dict) -> bool:
    files, path = _files(spark, folder)
    draft, final = (path(f"{folder}/{name}") for name in (
        f"drafts/{uuid.uuid4().hex}", f"manifests/{batch_id:020}.json"))
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    files.mkdirs(final.getParent())
    if not files.exists(final) and files.rename(draft, final):
        return True
    files.delete(draft, False)
    return False


def _tidy(spark: SparkSession, folder: str, kept: list[dict], outdated: list[dict]) -> None:
    """Drop old manifests, and runs that neither the newest manifest names nor the one that readers may still hold."""
    files, path = _files(spark, folder)
    names = {name for manifest in kept for _, name in manifest["runs"]}
    for manifest in outdated:
        files.delete(path(f"{folder}/manifests/{manifest['batch']:020}.json"), False)
    for status in files.listStatus(path(f"{folder}/runs")):
        if f"runs/{status.getPath().getName()}" not in names:
            files.delete(status.getPath(), True)
