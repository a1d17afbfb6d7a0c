"""Connected components of an edge table, in rounds of joins over written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filecensus.operators.scale import drop, new_table


TILE = "node bigint, links bigint, other bigint"


def tile_result(nodes: np.ndarray, copies: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Table:
    """What a tile of links between nodes[x] and nodes[y] comes down to, for each linked node.

    links: copies of the nodes it is linked to; other: the smallest node of the piece it is in. Nodes are sorted.
    """
    links = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(links, x, copies[y])
    np.add.at(links, y, copies[x])
    least, before = np.arange(len(nodes)), None
    while before is None or (before != least).any():
        before = least.copy()
        np.minimum.at(least, x, least[y])
        np.minimum.at(least, y, least[x])
        least = least[least]
    some = links > 0
    return pa.table({"node": nodes[some], "links": links[some], "other": nodes[least][some]})


def connected(edges: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) of every node of an edge table with columns a and b (long).

    Two kinds of rounds take turns: every node hands its larger neighbours, then its smaller ones, to the smallest
    neighbour it knows. The trees they make shrink to stars in a number of rounds that grows with the logarithm of
    the graph. Each round is a table of its own; the one before it is dropped. A node with very many neighbours is
    one row on one side of each join, and its edges are many rows that adaptive execution may split on the other.
    Loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    mark = (None, None)
    folder = _write(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        table = spark.read.parquet(folder)
        found = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
        larger = _write(_large_star(table))
        smaller = _write(_small_star(spark.read.parquet(larger)))
        drop(spark, folder)
        drop(spark, larger)
        folder = smaller
    ends = table.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ends)


def _write(frame: DataFrame) -> str:
    folder = new_table(frame.sparkSession)
    frame.write.parquet(folder)
    return folder


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter(
        "a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
        least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()
