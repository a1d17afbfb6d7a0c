"""Shards from a weighted hash tree: every row descends region, rack and shard by hash draws.

At each node the children draw: child c with weight w (the sum of the weights below it) gets the score
-ln(u)/w, where u in (0, 1) comes from a hash of the row's key and the path of c. The smallest score wins, so a
child wins in proportion to its weight, and its score depends on nothing but the key, its path and its weight.
Raising one shard's weight therefore moves rows only into the subtrees that hold it, lowering it only out of
them; a new region takes rows only into itself.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from filecensus.operators.scale import cut_lineage

# region, rack, shard number, weight
Leaf = tuple[str, str, int, float]

_POSITION = (1 << 33) - 1


def even_tree(shards: int) -> list[Leaf]:
    """Equal shards, two to a rack and two racks to a region.

    One more shard opens a rack or a region only after all before it are full, so for a multiple of four the
    shard added is a region of its own and takes rows only into itself.
    """
    return [(f"region{i // 4}", f"rack{i // 2 % 2}", i, 1.0) for i in range(shards)]


def _children(tree: Sequence[Leaf]) -> dict[str, dict[str, float]]:
    if len({leaf[2] for leaf in tree}) < len(tree) or not tree:
        raise ValueError("a tree needs shards, each once")
    found: dict[str, dict[str, float]] = defaultdict(dict)
    for region, rack, shard, weight in tree:
        if not weight >= 0:
            raise ValueError("weights must not be negative")
        path = ""
        for name in (region, rack, str(shard)) if weight else ():
            found[path][name] = found[path].get(name, 0.0) + weight
            path = f"{path}/{name}"
    if not found:
        raise ValueError("some shard needs a weight")
    return found


def _draw(key: Column, path: Column, kids: Column) -> Column:
    def score(kid: Column) -> Column:
        drawn = F.shiftrightunsigned(F.xxhash64(key, F.concat(path, F.lit("/"), kid["name"])), 11)
        uniform = (drawn.cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(uniform) / kid["weight"]).alias("score"), kid["name"].alias("name"))

    return F.array_min(F.transform(kids, score))["name"]


def place(rows: DataFrame, key: Column, tree: Sequence[Leaf], prefix: str = "") -> DataFrame:
    """Add `region`, `rack` and `shard` (int), each with `prefix`, as the tree sends the row's key.

    Equal keys go to equal shards; a null key is a key of its own. Runs where the rows are, without a shuffle.
    """
    nodes = _children(tree)
    literals = F.create_map(*[x for path, kids in nodes.items() for x in (F.lit(path), F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in kids.items()]))])
    # The null key is told from every string by its first character.
    text = F.when(key.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), key.cast("string")))
    path, names = F.lit(""), [f"{prefix}{level}" for level in ("region", "rack", "shard")]
    placed = rows.withColumn("_key", text)
    for name in names:
        placed = placed.withColumn(name, _draw(F.col("_key"), path, F.element_at(literals, path)))
        path = F.concat(path, F.lit("/"), F.col(name))
    return placed.withColumn(names[-1], F.col(names[-1]).cast("int")).drop("_key")


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], name: str = "slot") -> DataFrame:
    """Add gapless places from 0 within each shard, by `order`; rows alike in it come in any order.

    Rows are range-partitioned by shard and order, so a shard spreads over many tasks. Only one count per task
    and shard (at most tasks + shards, as the range is sorted by shard) is summed up in one place.
    """
    before = F.monotonically_increasing_id()
    table = cut_lineage(rows.withColumn("_tie", before).orderBy(shard, *order, "_tie").drop("_tie")
                        .withColumn("_place", F.monotonically_increasing_id()))
    table = table.withColumn("_part", F.shiftright("_place", 33))
    counts = table.groupBy("_part", shard).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.col(shard).alias("_shard"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.col("_first").bitwiseAND(F.lit(_POSITION)).alias("_head"))
    joined = table.join(F.broadcast(offsets), (table["_part"] == offsets["_part"]) & F.col(shard).eqNullSafe(
        F.col("_shard")))
    place_in = F.col("_place").bitwiseAND(F.lit(_POSITION)) - F.col("_head") + F.col("_before")
    return joined.select(*rows.columns, place_in.alias(name))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard, slot and size of every document, under the law `key`: doc_id and the number of shards decide.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, region, rack, shard, slot and grown_shard, where
    the row goes with one shard more. A null text counts as empty (size 1, checksum 0); a null doc_id is one key;
    repeated doc_ids go to one shard and take slots of their own; other columns of `docs` are not looked at. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        "doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = place(sized, F.col("doc_id"), even_tree(shards))
    grown = place(placed, F.col("doc_id"), _grown(shards), prefix="grown_").drop("grown_region", "grown_rack")
    return with_slots(grown, "shard", ["doc_id", "text_crc32", "size"])


@functools.cache
def _grown(shards: int) -> tuple[Leaf, ...]:
    """The tree with one shard more, as a region of its own."""
    return (*even_tree(shards), (f"region{(shards + 3) // 4}", "rack0", shards, 1.0))
