"""Dumped listing pages."""

from __future__ import annotations

import itertools
import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filecensus.operators.scale import cut_lineage, ordinal_chunk, ranked
from filecensus.schemas import DRIVES_PAGE, LISTING_PAGE

# Names of the two sources every account has.
MY_DRIVE = "My Drive"
SHARED_WITH_ME = "Shared with me"
# Place of the shared items: behind every shared drive, and small enough for ordinals to stay bigints.
SHARED_ORDINAL = 1_000_000
# Items a page can hold: pages and places on them make up positions.
_PAGE_ITEMS = 1 << 20


def read_sources(spark: SparkSession, drives: str) -> DataFrame:
    """Listing sources in order: My Drive, the shared drives as listed, then the shared items.

    `drives` holds the dumped drive pages, page-<n>.json.
    """
    pages = spark.read.schema(DRIVES_PAGE).option("multiLine", True).json(drives)
    listed = pages.select(_page_number().alias("page"), F.posexplode("drives").alias("pos", "drive"))
    # An account sees few drives; they are numbered one behind the other, however wide the pages are.
    place = F.row_number().over(Window.orderBy("page", "pos"))
    fits = F.when(place < SHARED_ORDINAL, place).otherwise(F.raise_error(F.lit("too many shared drives")))
    shared = listed.withColumn("source_ordinal", fits.cast("int")).select(
        "source_ordinal",
        F.col("drive.id").alias("drive_id"), F.coalesce("drive.name", "drive.id").alias("drive_name"),
        F.lit(False).alias("shared_with_me"))
    ends = spark.createDataFrame(
        [(0, "", MY_DRIVE, False), (SHARED_ORDINAL, "", SHARED_WITH_ME, True)],
        "source_ordinal int, drive_id string, drive_name string, shared_with_me boolean")
    return ends.unionByName(shared)


def _page_number():
    return F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+)\.json", 1).cast("bigint")


def _item_columns(position) -> list:
    item = F.col("item")
    return [
        position.alias("position"), item["id"].alias("id"), item["name"].alias("name"),
        F.coalesce(item["mimeType"], F.lit("")).alias("mime_type"), item["parents"].alias("parents"),
        item["size"].alias("size"), item["modifiedTime"].alias("modified_time"),
        F.transform(item["owners"], lambda o: o["emailAddress"]).alias("owners"),
        item["shortcutDetails"]["targetId"].alias("shortcut_target"),
    ]


def _read_pages(spark: SparkSession, folder: str, key: str) -> DataFrame:
    pages = spark.read.schema(f"{LISTING_PAGE}, {key}").option("multiLine", True).json(folder)
    page = _page_number()
    rows = pages.select(key.split()[0], page.alias("page"), F.posexplode("files").alias("pos", "item"))
    place = F.when(F.col("pos") < _PAGE_ITEMS, F.col("pos")).otherwise(F.raise_error(F.lit("a page is too long")))
    live = rows.filter(~F.coalesce(F.col("item.trashed"), F.lit(False)))
    return live.select(key.split()[0], *_item_columns(F.col("page") * _PAGE_ITEMS + place))


def read_listing(spark: SparkSession, folder: str, sources: DataFrame) -> DataFrame:
    """Listing items of every source, from folder/source_ordinal=<n>/page-<m>.json.

    Items in the bin are left out; `position` follows pages and places on them.
    """
    items = _read_pages(spark, folder, "source_ordinal int")
    # One row per drive the account can see, and all items in a few sources: joined by a shuffle, they would be few tasks.
    return items.join(F.broadcast(sources), "source_ordinal")


def read_children(spark: SparkSession, folder: str) -> DataFrame:
    """Items of dumped folder listings, from folder/folder_id=<id>/page-<m>.json."""
    return _read_pages(spark, folder, "folder_id string")


# Items of a page, as clients ask for them.
PAGE_SIZE = 1000


def dump_listing(items: DataFrame, folder: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """Write listing items as the pages that `read_listing` reads, in their order; the pages that were written.

    `items` has source_ordinal, position and the item columns. `folder` is mounted on all machines; a page appears
    under its name when it is complete.
    """
    place = ["source_ordinal", "page"]
    owners = F.transform("owners", lambda o: F.struct(o.alias("emailAddress")))
    item = F.struct(
        "id", "name", F.col("mime_type").alias("mimeType"), "parents", "size", F.col("modified_time").alias("modifiedTime"),
        owners.alias("owners"), F.when(F.col("shortcut_target").isNotNull(), F.struct(
            F.col("shortcut_target").alias("targetId"))).alias("shortcutDetails"))
    nth = ranked(items, ["source_ordinal"], ["position"], ordinal_chunk("position"), "nth")
    paged = nth.withColumn("page", F.floor(F.col("nth") / page_size)).select(*place, "nth", F.to_json(item).alias("text"))
    # Items come in order, so a task holds those of one page.
    pages = paged.repartition(*place).sortWithinPartitions(*place, "nth").drop("nth")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = itertools.chain.from_iterable(
            zip(frame["source_ordinal"], frame["page"], frame["text"]) for frame in frames)
        for (source, page), rows in itertools.groupby(items, key=lambda row: row[:2]):
            own = os.path.join(folder, f"source_ordinal={source}")
            os.makedirs(own, exist_ok=True)
            draft = os.path.join(own, f".draft-{uuid.uuid4().hex}")
            with open(draft, "w", encoding="utf-8") as file:
                file.write('{"files":[' + ",".join(text for _, _, text in rows) + "]}")
            os.replace(draft, os.path.join(own, f"page-{page}.json"))
            yield pd.DataFrame([(source, page)], columns=place)

    return cut_lineage(pages.mapInPandas(write, "source_ordinal int, page bigint"))


def dump_drives(sources: DataFrame, folder: str) -> None:
    """Write the shared drives among listing sources (an account sees few) as the page that `read_sources` reads."""
    drives = sources.filter("drive_id <> ''").orderBy("source_ordinal").select("drive_id", "drive_name").collect()
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "page-0.json"), "w", encoding="utf-8") as file:
        json.dump({"drives": [{"id": row["drive_id"], "name": row["drive_name"]} for row in drives]}, file)
