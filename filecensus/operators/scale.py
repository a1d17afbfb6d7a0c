"""Building blocks that keep hot keys and long orders off single tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

# Rows of one key that go to one task of a lookup; a key with more is split.
HOT_ROWS = 1_000_000
# Rows of one key that share a task when an order must be followed.
CHUNK_ROWS = 1_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session: its checkpoint folder, else one below its warehouse.

    A warehouse on a machine's own disk is shared only where there is one machine.
    """
    set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (set_by_call.get() if set_by_call.isDefined() else None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{warehouse}/checkpoints"


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{checkpoint_folder(spark)}/filecensus-{spark.sparkContext.applicationId}"


def new_table(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames built on them end with it."""
    drop(spark, run_folder(spark))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    It outlives lost executors, later passes read only the columns they need, and its true size
    lets joins with it be planned from the start.
    """
    table = new_table(frame.sparkSession)
    frame.write.parquet(table)
    return frame.sparkSession.read.schema(frame.schema).parquet(table)


def cut_lineage_counted(frame: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """`cut_lineage`, and aggregates over the rows that were taken while they were written."""
    seen = Observation()
    table = cut_lineage(frame.observe(seen, *[value.alias(name) for name, value in measures.items()]))
    return table, seen.get


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, spread: Column,
           hot_rows: int = HOT_ROWS, heaviest: int | None = None) -> DataFrame:
    """Left join `rows` to one-row-per-key `facts` without gathering a hot key's rows in one task.

    `weight` is the facts column that counts the key's rows. The fact of a key with `hot_rows` rows or
    more is repeated once for every `hot_rows` of them, and its rows pick one of the copies by a hash of
    `spread`. Which keys are hot is broadcast: the keys alone, of which there can be no more than
    rows / hot_rows. Where the caller knows that the `heaviest` key has fewer, a plain join does.
    """
    if heaviest is not None and heaviest < hot_rows:
        return _plain_lookup(rows, facts, keys)
    values = [c for c in facts.columns if c not in keys]
    copies = F.ceil(F.col(weight) / hot_rows).cast("int")
    hot = facts.filter(F.col(weight) >= hot_rows).select(*keys, copies.alias("_copies"))
    salted = facts.select(
        *keys, F.struct(*values).alias("_fact"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), copies) - 1)).alias("_salt"))
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_copies")).cast("int"), F.lit(0))
    joined = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(salted, [*keys, "_salt"], "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.col("_fact")[v].alias(v) for v in values])


def _plain_lookup(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in facts.columns if c not in keys]
    joined = rows.join(facts.select(*keys, *[F.col(c).alias(f"_of_{c}") for c in values]), keys, "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.col(f"_of_{c}").alias(c) for c in values])


def lookup_unweighted(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column,
                      hot_rows: int = HOT_ROWS, at_most: int | None = None) -> DataFrame:
    """`lookup` for facts that do not know how many rows will ask for them.

    Where the caller knows that there are fewer than `hot_rows` rows in all, no key can be hot, and a plain join does.
    """
    if at_most is not None and at_most < hot_rows:
        return _plain_lookup(rows, facts, keys)
    asked = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_asked"))
    return lookup(rows, facts.join(asked, keys), keys, "_asked", spread, hot_rows).drop("_asked")


def newest(rows: DataFrame, keys: list[str], order: str, **more: Column) -> DataFrame:
    """The rows with the largest `order` of their key, and besides them aggregates over all rows of the key.

    Null keys are a key; rows without an order are left out, rows of equal order all stay. Only keys and
    fixed-width values are aggregated, so tasks hash rather than sort, and whole rows are read once,
    by a join with one row per key.
    """
    tops = rows.filter(F.col(order).isNotNull()).groupBy(*keys).agg(
        F.max(order).alias("_top"), *[value.alias(name) for name, value in more.items()])
    tops = tops.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    same = F.col(order) == F.col("_top")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return rows.join(tops, same).drop("_top", *[f"_of_{key}" for key in keys])


def running_totals(rows: DataFrame, keys: list[str], order: list[str], chunk: Column,
                   measures: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums per key in `order`, chunk by chunk.

    `chunk` must rise with `order` and bound the rows of one task. Totals of the chunks before are
    summed on one small row per key and chunk, so a key that holds a third of all rows still runs
    in as many tasks as it has chunks.
    """
    chunked = rows.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    sums = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(m).alias(f"_{n}") for n, m in measures.items()])
    offsets = sums.select(*keys, "_chunk", *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in measures])
    offsets = offsets.filter(" OR ".join(f"`_{n}` <> 0" for n in measures))
    local = chunked.select("*", *[F.sum(m).over(inside).alias(n) for n, m in measures.items()])
    joined = local.join(offsets, [*keys, "_chunk"], "left")
    totals = [(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in measures]
    return joined.select(*rows.columns, *totals)


def ranked(rows: DataFrame, keys: list[str], order: list[str], chunk: Column | None, name: str,
           first: str | None = None) -> DataFrame:
    """Zero-based place of every row within its key, and as `first` the key's smallest `order[0]`.

    Without a chunk, keys are known to be small.
    """
    firsts = {} if first is None else {first: order[0]}
    chunked = rows.withColumn("_chunk", F.lit(0) if chunk is None else chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = chunked.select(
        "*", (F.row_number().over(inside).cast("bigint") - 1).alias(name),
        *[F.first(source).over(inside).alias(out) for out, source in firsts.items()])
    if chunk is None:
        return local.drop("_chunk")
    counts = chunked.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(source).alias(f"_{out}") for out, source in firsts.items()])
    across = Window.partitionBy(*keys).orderBy("_chunk")
    later = counts.select(
        *keys, "_chunk", F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        *[F.first(f"_{out}").over(across).alias(f"_{out}") for out in firsts]).filter("_before > 0")
    place = (F.col(name) + F.coalesce("_before", F.lit(0))).alias(name)
    heads = [F.coalesce(f"_{out}", out).alias(out) for out in firsts]
    return local.join(later, [*keys, "_chunk"], "left").select(*rows.columns, place, *heads)


def ordinal_chunk(ordinal: str = "ordinal", chunk_rows: int = CHUNK_ROWS) -> Column:
    """Chunk of unique integer ordinals: no chunk can hold more than `chunk_rows` rows."""
    return F.floor(F.col(ordinal) / chunk_rows).cast("bigint")


def with_context(rows: DataFrame, place: str, before: int, block_rows: int) -> DataFrame:
    """Cut each key into blocks and repeat the last `before` rows of a block at the head of the next.

    A window over (key, `block`) that looks back at most `before` rows is then exact for the rows
    whose `context` is false.
    """
    if before > block_rows:
        raise ValueError("a block must hold at least the rows looked back on")
    block = F.floor(F.col(place) / block_rows).cast("bigint")
    own = F.struct(block.alias("block"), F.lit(False).alias("context"))
    ahead = F.struct((block + 1).alias("block"), F.lit(True).alias("context"))
    copies = F.when(F.col(place) % block_rows >= block_rows - before, F.array(own, ahead)).otherwise(F.array(own))
    return rows.select("*", F.inline(copies))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense zero-based row numbers over the whole table, from a range-partitioned sort.

    Only one row count per partition is summed in one place.
    """
    sorted_rows = cut_lineage(rows.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_slot"), 33).alias("_part")
    counts = sorted_rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    joined = sorted_rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.select(*rows.columns, (F.col("_offset") + inside).alias(name))
