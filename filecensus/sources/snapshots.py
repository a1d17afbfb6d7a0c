"""Catalog snapshots: a partitioned table for work, numbered JSON documents for interchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filecensus.operators.catalog import coerce_entries, status_counts, upsert
from filecensus.schemas import ENTRY, ENTRY_COLUMNS, SNAPSHOT_DOCUMENT

_KEYS = ["account", "snapshot"]
# Ordinals whose entries share an exported document.
DOCUMENT_ENTRIES = 10_000
HEADER = "expected_total bigint, expected_bytes bigint, count bigint, done bigint, total_bytes bigint"


def write_snapshot(entries: DataFrame, account: str, snapshot: str, expected_total: int, expected_bytes: int,
                   roots: list[str]) -> None:
    """Write entries and header below every root; a snapshot written again replaces itself.

    Headers are a table of their own, so status readers never touch the entries.
    """
    labelled = entries.withColumns({"account": F.lit(account), "snapshot": F.lit(snapshot)})
    header = status_counts(entries).select(
        F.lit(account).alias("account"), F.lit(snapshot).alias("snapshot"),
        F.lit(expected_total).cast("bigint").alias("expected_total"),
        F.lit(expected_bytes).cast("bigint").alias("expected_bytes"), "count", "done", "total_bytes")
    for root in roots:
        for rows, name in ((labelled, "entries"), (header, "headers")):
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*_KEYS).parquet(f"{root}/{name}"))


def read_entries(spark: SparkSession, root: str, account: str | None = None, snapshot: str | None = None) -> DataFrame:
    return _read(spark, f"{root}/entries", ENTRY, account, snapshot)


def read_headers(spark: SparkSession, root: str, account: str | None = None, snapshot: str | None = None) -> DataFrame:
    return _read(spark, f"{root}/headers", HEADER, account, snapshot)


def _read(spark, folder, columns, account, snapshot):
    # The stated schema keeps partition names text: accounts may look like numbers.
    rows = spark.read.schema(f"{columns}, account string, snapshot string").parquet(folder)
    if account is not None:
        rows = rows.filter(F.col("account") == account)
    return rows if snapshot is None else rows.filter(F.col("snapshot") == snapshot)


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Interchange documents, one row each, with `account` and `snapshot` from .../<snapshot>/<account>/<file>."""
    # A whole file is one record: no JSON holds the separator. In Spark's multiLine mode each number that is read as text
    # costs one more read of the file. Documents are UTF-8, as JSON for interchange is.
    rows = spark.read.schema(SNAPSHOT_DOCUMENT).option("lineSep", "\0").json(paths)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.withColumns({
        "snapshot": F.element_at(parts, -3),
        "account": F.coalesce(F.when(F.col("account") != "", F.col("account")), F.element_at(parts, -2)),
    })


def document_entries(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of interchange documents with types settled, and the rows that cannot be.

    An id met twice keeps its first place and its last values.
    """
    first = F.coalesce(F.col("first_ordinal").try_cast("bigint"), F.lit(0)).alias("_first")
    rows = documents.select(*_KEYS, first, F.posexplode("entries").alias("ordinal", "entry"))
    flat = rows.select(*_KEYS, (F.col("_first") + F.col("ordinal")).alias("ordinal"), "entry.*")
    keyed = flat.withColumn("_id", F.struct(*_KEYS, F.coalesce("file_id", F.lit("")).alias("file_id")))
    merged = upsert(keyed, "_id")
    return coerce_entries(merged.drop("_id").withColumn("file_id", F.coalesce("file_id", F.lit(""))))


def document_headers(documents: DataFrame) -> DataFrame:
    """Header scalars without the entries, once for all parts of a snapshot."""
    numbers = [field.split()[0] for field in HEADER.split(", ")]
    return documents.filter(F.coalesce("part", F.lit("0")) == "0").select(
        *_KEYS, *[F.coalesce(F.col(n).try_cast("bigint"), F.lit(0)).alias(n) for n in numbers])


def export_snapshot(entries: DataFrame, account: str, snapshot: str, expected_total: int, expected_bytes: int,
                    folder: str) -> None:
    """Export one snapshot as numbered interchange documents below folder/<snapshot>/<account>, one a file.

    Each is a JSON object with the header, its part number, the place of its first entry in the whole, and its
    entries in order: those of DOCUMENT_ENTRIES ordinals, so that many tasks write and read them. `read_documents`
    reads them back. A snapshot without entries is one document.
    """
    names = [c for c in ENTRY_COLUMNS if c != "ordinal"]
    chunk = F.floor(F.col("ordinal") / DOCUMENT_ENTRIES).alias("_chunk")
    listed = F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*names).alias("entry"))))
    chunks = entries.groupBy(chunk).agg(F.transform(listed, lambda x: x["entry"]).alias("entries"))
    # One small row for each document.
    before = Window.orderBy("_chunk")
    places = entries.groupBy(chunk).agg(F.count(F.lit(1)).alias("_n")).select(
        "_chunk", (F.row_number().over(before) - 1).alias("part"),
        (F.sum("_n").over(before) - F.col("_n")).alias("first_ordinal"))
    parts = chunks.join(places, "_chunk")
    if entries.isEmpty():
        parts = entries.agg(F.lit(0).alias("part"), F.lit(0).alias("first_ordinal"),
                            F.array().cast(chunks.schema["entries"].dataType).alias("entries"))
    head = status_counts(entries).first()
    (parts.select(
        F.lit(account).alias("account"), F.lit(expected_total).alias("expected_total"),
        F.lit(expected_bytes).alias("expected_bytes"),
        *[F.lit(head[c]).alias(c) for c in ("count", "done", "total_bytes")], "part", "first_ordinal", "entries")
     .write.mode("overwrite").option("maxRecordsPerFile", 1).json(f"{folder}/{snapshot}/{account}"))
