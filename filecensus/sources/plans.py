"""Editable plans as CSV, and reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filecensus.operators.scale import numbered
from filecensus.schemas import PLAN_COLUMNS


def write_plan(plan: DataFrame, folder: str) -> None:
    """CSV files with a header; rows keep their order within and across files."""
    rows = plan.orderBy("ordinal") if "ordinal" in plan.columns else plan
    rows.select(*PLAN_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", "").csv(folder)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Plan rows with `plan_ordinal`, their order in the file. Column names are read from the header,
    whose byte order mark, if an editor left one, is dropped."""
    reader = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
              .option("escape", '"').option("nullValue", "").option("encoding", "UTF-8"))
    rows = reader.csv(path)
    named = {c.lstrip("\ufeff"): c for c in rows.columns}
    wanted = [F.col(f"`{named[c]}`") if c in named else F.lit(None) for c in PLAN_COLUMNS]
    texts = [F.coalesce(col.cast("string"), F.lit("")).alias(c) for col, c in zip(wanted, PLAN_COLUMNS)]
    # A quoted field may span lines, so a file is one split; file names order the parts.
    place = F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id())
    return numbered(rows.select(*texts, place.alias("_place")), ["_place"], "plan_ordinal").drop("_place")


def write_report(row: DataFrame, path: str, details: DataFrame | None = None) -> None:
    """A one-row report as JSON; its list, if it has one, as JSON lines beside it."""
    row.write.mode("overwrite").json(f"{path}/summary")
    if details is not None:
        details.write.mode("overwrite").json(f"{path}/details")


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The row of a report."""
    return spark.read.schema(schema).json(f"{path}/summary")
