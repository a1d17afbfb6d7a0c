"""Files on shared storage: listing, hashing, reading texts and copying."""

from __future__ import annotations

import codecs
import hashlib
import io
import itertools
import os
import shutil
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from filecensus.operators.scale import cut_lineage, cut_lineage_counted

CHUNK = 1024 * 1024
# Names a folder scan hands on at a time, folders one task should scan.
SCAN_ROWS = 10_000
FOLDERS_PER_TASK = 1000
# Files whose sizes one task should ask.
FILES_PER_TASK = 10_000
# Bytes of files one task should handle.
TASK_BYTES = 1024 ** 3


def local_path(url: str) -> str:
    """The path of a folder that is mounted on all machines; other storage has no files to open."""
    parts = urllib.parse.urlparse(url)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{url} is no mounted folder")
    return parts.path if parts.scheme else url


def list_tree(spark: SparkSession, root: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """(rel_path, size, modified) of every file below `root`, which all executors mount.

    Spark's own file sources pass over empty files and names that start with a dot or underscore,
    which are just what junk rules and quarantine are about. So tasks read the names in the folders,
    one level of the tree per round, and hand them on as they come. Sizes and times, which cost a call a
    file, are asked by other tasks among which all names are spread, so a folder that holds most
    files is many tasks. A file whose size cannot be asked has none.
    """
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["rel_path"]:
                found = _scan_folder(root, folder)
                while rows := list(itertools.islice(found, SCAN_ROWS)):
                    yield pd.DataFrame(rows, columns=["rel_path", "is_folder"])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *_size_and_time(os.path.join(root, path))) for path in frame["rel_path"]]
            sizes = pd.array([row[1] for row in rows], dtype="Int64")
            yield pd.DataFrame({"rel_path": frame["rel_path"], "size": sizes, "modified": [row[2] for row in rows]})

    tasks = spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([("",)], "rel_path string")
    files, count = None, 0
    while not folders.isEmpty():
        level = cut_lineage(folders.repartition(tasks, "rel_path").mapInPandas(scan, "rel_path string, is_folder boolean"))
        here = level.filter("NOT is_folder").select("rel_path")
        files = here if files is None else files.unionByName(here)
        folders = level.filter("is_folder").select("rel_path")
        fresh, inner = level.agg(F.count_if(~F.col("is_folder")), F.count_if("is_folder")).first()
        count += fresh
        tasks = max(tasks, min(100_000, inner // FOLDERS_PER_TASK))
    spread = files.repartition(max(spark.sparkContext.defaultParallelism, min(100_000, count // files_per_task)), "rel_path")
    asked = spread.mapInPandas(ask, "rel_path string, size bigint, modified double")
    return asked.select("rel_path", "size", F.timestamp_seconds("modified").alias("modified"))


def _scan_folder(root: str, folder: str) -> Iterator[tuple]:
    with os.scandir(os.path.join(root, folder)) as entries:
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                yield path, True
            elif entry.is_file():
                yield path, False


def _size_and_time(path: str) -> tuple[int | None, float | None]:
    try:
        stat = os.stat(path)
    except OSError:
        return None, None
    return stat.st_size, stat.st_mtime


def write_texts(rows: DataFrame, root: str) -> DataFrame:
    """Write `text` of every row to `rel_path` below `root`; the paths that were written, as a written table."""
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["rel_path"], frame["text"]):
                place = os.path.join(root, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                part = _part_name(place)
                with open(part, "wb") as file:
                    file.write((text or "").encode())
                os.replace(part, place)
            yield frame[["rel_path"]]

    return cut_lineage(rows.select("rel_path", "text").mapInPandas(write, "rel_path string"))


def _part_name(place: str) -> str:
    return os.path.join(os.path.dirname(place), f".part-{uuid.uuid4().hex}")


def hash_tree(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """(rel_path, size, sha256, readable) of the files below `root`, or of those in `paths`.

    Tasks read their files in chunks, so neither a file's size nor memory limits it.
    """
    listed = list_tree(spark, root).select("rel_path", "size")
    if paths is not None:
        listed = listed.join(paths.select("rel_path").distinct(), "rel_path", "left_semi")
    base = root

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = [_sha256(os.path.join(base, p)) for p in frame["rel_path"]]
            yield frame.assign(sha256=hashes, readable=[h is not None for h in hashes])

    return _spread(listed, "rel_path").mapInPandas(digest, "rel_path string, size bigint, sha256 string, readable boolean")


def _spread(files: DataFrame, key: str) -> DataFrame:
    """Spread files over enough tasks for their bytes. The rows are small, so the number is stated:
    sized by the rows, all files would end up in one task. They are written first, as finding them may cost a call a
    file, and are counted meanwhile."""
    files, seen = cut_lineage_counted(files, bytes=F.sum("size"))
    total = seen["bytes"] or 0
    least = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(least, min(100_000, total // TASK_BYTES)), F.col(key))


def _sha256(path: str) -> str | None:
    state = hashlib.sha256()
    try:
        with open(path, "rb") as source:
            while chunk := source.read(CHUNK):
                state.update(chunk)
    except OSError:
        return None
    return state.hexdigest()


def read_texts(candidates: DataFrame, root: str) -> DataFrame:
    """Candidates found below `root` with their `text`; bytes that are no UTF-8 are dropped."""
    schema = StructType([*candidates.schema.fields, StructField("text", StringType())])

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[_text(os.path.join(root, p)) for p in frame["rel_path"]])

    return _spread(candidates, "rel_path").mapInPandas(load, schema).filter("text IS NOT NULL")


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="ignore", newline=None) as source:
            return source.read()
    except OSError:
        return None


def read_text_parts(candidates: DataFrame, root: str, part_bytes: int = CHUNK) -> DataFrame:
    """`read_texts` in parts of so many bytes: each candidate once for every `part` of its text, from 0.

    A character, or a line end of two, that a cut falls into belongs to the part that completes it, so the parts of
    a file are its text. No task holds more than one part of a file besides CHUNK characters of others; parts are handed
    on together, as many small ones would cost more than their bytes.
    """
    schema = StructType([*candidates.schema.fields, StructField("part", IntegerType()), StructField("text", StringType())])

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, numbers, texts, held = [], [], [], 0
            for i, path in enumerate(frame["rel_path"]):
                for number, text in enumerate(_text_parts(os.path.join(root, path), part_bytes)):
                    rows.append(i)
                    numbers.append(number)
                    texts.append(text)
                    held += len(text)
                    if held >= CHUNK:
                        yield frame.iloc[rows].assign(part=numbers, text=texts)
                        rows, numbers, texts, held = [], [], [], 0
            if rows:
                yield frame.iloc[rows].assign(part=numbers, text=texts)

    return _spread(candidates, "rel_path").mapInPandas(load, schema)


def _text_parts(path: str, part_bytes: int) -> Iterator[str]:
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("ignore"), translate=True)
    try:
        with open(path, "rb") as source:
            while data := source.read(part_bytes):
                yield decoder.decode(data)
    except OSError:
        return
    yield decoder.decode(b"", final=True)


def apply_copies(routing: DataFrame, source: str, target: str) -> DataFrame:
    """Copy every routed file; one result row per file, and a failed file stops nothing.

    The results are a written table: its commit is the log of the copy, in which a task that ran twice has its rows
    once, and reading them copies nothing again. Data goes to a temporary name beside the target first and is
    renamed when complete, so no attempt leaves half a file under a real name; what attempts that died have left is
    swept up when all are done. Both roots must be storage that all executors mount.
    """
    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = [_copy_one(source, target, a, b) for a, b in zip(frame["src_rel"], frame["dest_rel"])]
            yield frame.assign(sha256=[r[0] for r in results], error=[r[1] for r in results])

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["folder"]:
                _sweep(os.path.join(target, folder))
            yield frame.iloc[:0]

    rows = _spread(routing.select("ordinal", "src_rel", "dest_rel", "size"), "src_rel")
    log = cut_lineage(rows.mapInPandas(
        copy, "ordinal bigint, src_rel string, dest_rel string, size bigint, sha256 string, error string"))
    folders = log.filter("error IS NULL").select(F.regexp_extract("dest_rel", "^(.*?)/?[^/]*$", 1).alias("folder")).distinct()
    folders.mapInPandas(sweep, "folder string").count()
    return log


def _sweep(folder: str) -> None:
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.name.startswith(".part-"):
                os.unlink(entry.path)


def _copy_one(source: str, target: str, src_rel: str, dest_rel: str) -> tuple[str | None, str | None]:
    origin = os.path.join(source, src_rel)
    place = os.path.normpath(os.path.join(target, dest_rel))
    if not place.startswith(os.path.normpath(target) + os.sep):
        return None, "destination lies outside the target"
    part = _part_name(place)
    state = hashlib.sha256()
    try:
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(origin, "rb") as reader, open(part, "wb") as writer:
            while chunk := reader.read(CHUNK):
                state.update(chunk)
                writer.write(chunk)
        shutil.copystat(origin, part)
        os.replace(part, place)
    except OSError as problem:
        if os.path.exists(part):
            os.unlink(part)
        return None, str(problem)
    return state.hexdigest(), None
