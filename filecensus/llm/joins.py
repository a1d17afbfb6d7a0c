"""Joins of whole texts with what was found out about some of them, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filecensus.operators.scale import cut_lineage

# A table of at most so many bytes is broadcast to the texts; beyond it, texts and table are shuffled together.
BROADCAST_BYTES = 48 * 1024 * 1024


def small_side(table: DataFrame, bytes_a_row: int, lists: str | None = None, bytes_a_value: int = 16) -> DataFrame:
    """A written table, marked for broadcast if its rows, with the values of a list column, are few enough."""
    return F.broadcast(table) if is_small(table, bytes_a_row, lists, bytes_a_value) else table


def is_small(table: DataFrame, bytes_a_row: int, lists: str | None = None, bytes_a_value: int = 16) -> bool:
    values = F.lit(0) if lists is None else F.size(lists)
    rows, listed = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(values), F.lit(0))).first()
    return rows * bytes_a_row + listed * bytes_a_value <= BROADCAST_BYTES


def join_listed(rows: DataFrame, listed: DataFrame, key: str, bytes_a_row: int) -> DataFrame:
    """Wide rows joined with a written table that lists some of their keys, which are numbers that stand close together.

    Where the table is too large to be broadcast, its keys alone are, as bits, so that only rows that are listed are
    shuffled.
    """
    if is_small(listed, bytes_a_row):
        return rows.join(F.broadcast(listed), key)
    word, bit = F.shiftright(F.col(key), 6), (F.col(key) % 64).cast("int")
    words = cut_lineage(listed.groupBy(word.alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits")))
    if is_small(words, 48):
        held = rows.join(F.broadcast(words), word == F.col("_word"))
        on = F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("bigint"))
        rows = held.filter(on == 1).select(*[F.col(c) for c in rows.columns])
    return rows.join(listed, key)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have yet."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def row_key(docs_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits for a row's id and text, by which it is found when it is read again; rows alike in both share them.

    The length of the id stands before it, so that no id runs on into a text.
    """
    name = F.col(docs_id).cast("string")
    head = F.concat(F.coalesce(F.octet_length(name).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(name, F.lit("")))
    return F.unhex(F.md5(F.concat(head, F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary")))


def smallest(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows whose key hashes to the smallest numbers, in that order; rows of equal keys come in any order.

    Rows whose hash is far too large are left out first, by the number of rows, so that tasks do not each send n
    rows to the one that picks.
    """
    total, place = rows.count(), F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = min(1.0, (4 * n + 100) / max(1, total))
    return rows.filter(place < F.lit(int(share * (1 << 40)))).orderBy(place).limit(n)
