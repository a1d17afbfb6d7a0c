"""Repairing the structure of conversations by a run-length dynamic program.

A conversation should read: perhaps one system row, then user and assistant in turns, the assistant last; or be
empty. Rows are kept, given another role or deleted, and rows are inserted, at the least cost. What the program knows
between two rows is one of four states (nothing yet, after system, after user, after assistant). A row has one of few
symbols, by its role and fault; its step is a 4 by 4 matrix of costs, which compose by min-plus products. Equal
neighbours collapse into a run, and a run is passed through the binary powers of its matrix, which are worked out once
per symbol. From the costs to come, known backwards, choices are unrolled forwards, the least edit first.

Rows are sorted over the whole cluster and each task cuts its part into pieces: the rows of one conversation, up to
PIECE of them. A conversation that fits one piece, as most do, is done there. For others each piece is first made one
matrix, a few small rows per conversation tell every piece the costs behind it and then the state before it, and all
pieces are unrolled side by side. Texts are not moved until it is known which rows remain.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from filecensus.operators.scale import cut_lineage

# Rows of a conversation that one task looks at together.
PIECE = 1 << 14
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_FAR = 1 << 50
_RETYPE, _DELETE, _INSERT, _TRUNCATED = 3, 4, 3, 3
# The one state that an inserted or retyped row leads to.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
# A mark is initial + 4 * fault.
_INITIALS = "sua"
_SOUND, _CUT_OFF, _BLANK, _DUPLICATE = range(4)
_BLANKS = " \t\n\x0b\x0c\r"

_Vector = tuple[int, int, int, int]
_Matrix = tuple[_Vector, _Vector, _Vector, _Vector]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults put in by crc32 of `conv_id:turn`, modulo 20.

    0 drops a row, 1 empties its text, 2 takes the marks .!? out of it, 3 repeats the row, 4 makes its role user.
    Nulls count as one space, but for the order and the identity of conversations.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    dice = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), dice.alias("dice"))
    marked = F.when(F.col("dice") == 1, "").when(
        F.col("dice") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("dice") == 3, 2).otherwise(1)
    return rows.filter("dice <> 0").select(
        "conv_id", "turn", F.when(F.col("dice") == 4, "user").otherwise(F.col("role")).alias("role"),
        marked.alias("text"), F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


def _named(*columns: Column) -> Column:
    """128 bits that tell values apart, nulls and the bounds between columns included."""
    parts = [F.concat(F.coalesce(F.octet_length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))
             for c in (column.cast("string") for column in columns)]
    return F.md5(F.concat(*parts))


def _content() -> Column:
    return F.unhex(_named(F.col("role"), F.col("text")))


def _row_key() -> Column:
    return _named(F.col("conv_id"), F.col("turn"), F.hex("content"))


def _without_nulls(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _marks(turns: DataFrame) -> DataFrame:
    """What the program needs of each row, without its text."""
    tail = F.rtrim("text", F.lit(_BLANKS))
    fault = F.when(tail == "", _BLANK).when(F.right(tail, F.lit(1)).isin(".", "!", "?"), _SOUND).otherwise(_CUT_OFF)
    initial = F.left("role", F.lit(1))
    kind = functools.reduce(lambda found, i: found.when(initial == _INITIALS[i], i), range(3), F.when(F.lit(False), 0))
    return turns.select("conv_id", "turn", "role", _content().alias("content"),
                        (kind.otherwise(3) + 4 * fault).cast("int").alias("mark"))


# The program.

def _product(left: _Matrix, right: _Matrix) -> _Matrix:
    return tuple(tuple(min(a + right[k][j] for k, a in enumerate(row)) for j in range(4)) for row in left)


def _onward(matrix: _Matrix, costs: _Vector) -> _Vector:
    (w, x, y, z) = costs
    return tuple(min(a + w, b + x, c + y, d + z) for a, b, c, d in matrix)


_NO_STEP: _Matrix = tuple(tuple(0 if i == j else _FAR for j in range(4)) for i in range(4))
_INSERTED = _NO_STEP
for _ in range(2):
    _INSERTED = tuple(tuple(min(cost, _INSERT + _INSERTED[_NEXT[i]][j]) for j, cost in enumerate(_INSERTED[i]))
                      for i in range(4))
# Costs at the end of a conversation: nothing, or after the assistant, but for insertions.
_END: _Vector = tuple(min(row[_NOTHING], row[_ASSISTANT]) for row in _INSERTED)


def _kept_state(mark: int, state: int) -> int | None:
    """Where a kept row leads to; None if it may not stand there."""
    if mark >= 4 * _BLANK:
        return None
    initial = mark % 4
    if initial == 0:
        return _SYSTEM if state == _NOTHING else None
    return _NEXT[state] if initial < 3 and _NEXT[state] == initial + 1 else None


@functools.cache
def _step(mark: int) -> _Matrix:
    """Costs of one row, with insertions before it."""
    rows = [[_DELETE if i == j else _FAR for j in range(4)] for i in range(4)]
    if mark < 4 * _BLANK:
        extra = _TRUNCATED if mark // 4 == _CUT_OFF else 0
        for state in range(4):
            rows[state][_NEXT[state]] = min(rows[state][_NEXT[state]], _RETYPE + extra)
            if (kept := _kept_state(mark, state)) is not None:
                rows[state][kept] = min(rows[state][kept], extra)
    return _product(_INSERTED, tuple(map(tuple, rows)))


@functools.cache
def _power(mark: int, bit: int) -> _Matrix:
    """The step of 2**bit equal rows."""
    return _step(mark) if bit == 0 else _product(_power(mark, bit - 1), _power(mark, bit - 1))


def runs(marks: bytes) -> list[tuple[int, int]]:
    """Equal neighbours as (mark, length)."""
    found, begin = [], 0
    for end in range(1, len(marks) + 1):
        if end == len(marks) or marks[end] != marks[begin]:
            found.append((marks[begin], end - begin))
            begin = end
    return found


def _powers(mark: int, length: int) -> Iterator[_Matrix]:
    bit = 0
    while length:
        if length & 1:
            yield _power(mark, bit)
        length >>= 1
        bit += 1


def piece_matrix(marks: bytes) -> _Matrix:
    """Costs of a piece from each state before it to each state behind it."""
    return functools.reduce(_product, (m for mark, length in runs(marks) for m in _powers(mark, length)), _NO_STEP)


def costs_between(marks: bytes, after: _Vector) -> list[tuple[int, int, _Vector]]:
    """(mark, length, costs to come behind it) of every run, by powers, from the last to the first."""
    found = []
    for mark, length in reversed(runs(marks)):
        found.append((mark, length, after))
        for matrix in _powers(mark, length):
            after = _onward(matrix, after)
    return found[::-1]


def unroll(marks: bytes, after: _Vector, state: int, last: bool) -> tuple[str, int]:
    """The cheapest edits of a piece, the ASCII-least of equal cost, and the state behind it."""
    audit: list[str] = []
    for mark, length, costs in costs_between(marks, after):
        ahead = [costs]
        step = _step(mark)
        for _ in range(length):
            ahead.append(_onward(step, ahead[-1]))
        extra = _TRUNCATED if mark // 4 == _CUT_OFF else 0
        for left in range(length, 0, -1):
            here, then = ahead[left], ahead[left - 1]
            while True:
                if _DELETE + then[state] == here[state]:
                    audit.append("D")
                    break
                if _INSERT + here[_NEXT[state]] == here[state]:
                    audit.append("I")
                    state = _NEXT[state]
                    continue
                kept = _kept_state(mark, state)
                if kept is not None and extra + then[kept] == here[state]:
                    audit.append("K")
                    state = kept
                else:
                    audit.append("R")
                    state = _NEXT[state]
                break
    while last and after[state]:
        audit.append("I")
        state = _NEXT[state]
    return "".join(audit), state


# Pieces.

_PIECE = ("conv_id {conv}, place bigint, open boolean, marks binary, turns array<{turn}>, roles array<string>, "
          "contents array<binary>")


def _cut(schema: pa.Schema, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows. A piece is open if its conversation may go on in another."""
    conv, rows, seen, number, first, out = None, [], set(), 0, True, []

    def piece(open_: bool) -> dict:
        part = rows[0][5]
        return {"conv_id": conv, "place": part << 33 | number - len(rows), "open": open_,
                "marks": bytes(row[4] for row in rows), "turns": [row[1] for row in rows],
                "roles": [row[2] for row in rows], "contents": [row[3] for row in rows]}

    held = 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            other = bool(rows) and row[0] != conv
            if other or len(rows) == size:
                out.append(piece(first or not other))
                held += len(rows)
                first, rows, seen = not other, [], set()
                if held >= size:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
            conv, mark = row[0], row[4]
            if row[3] not in seen:
                seen.add(row[3])
            elif mark < 4 * _BLANK:
                mark = mark % 4 + 4 * _DUPLICATE
            rows.append((*row[:4], mark, row[5]))
            number += 1
    if rows:
        out.append(piece(True))
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _mapped(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`function` makes a dict of a row's values, for every row."""
    names = rows.columns

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(
                [function(*values) for values in zip(*(batch.column(n).to_pylist() for n in names), strict=True)],
                schema=arrow)

    arrow = _arrow_schema(rows.sparkSession, schema)
    return rows.mapInArrow(mapped, schema)


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def pieces(turns: DataFrame, size: int = PIECE) -> DataFrame:
    """All rows by conversation and turn, in pieces of up to `size`; duplicates within a piece are marked."""
    spark, kinds = turns.sparkSession, dict(turns.dtypes)
    schema = _PIECE.format(conv=kinds["conv_id"], turn=kinds["turn"])
    # Rows alike in everything may be parted anywhere.
    order = ["conv_id", "turn", "role", "content", "tie"]
    rows = _marks(turns).withColumn("tie", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", "content", "mark", F.spark_partition_id().cast("bigint"))
    return cut_lineage(ordered.mapInArrow(functools.partial(_cut, _arrow_schema(spark, schema), size), schema))


def _settled(cut: DataFrame) -> DataFrame:
    """The pieces, with what those of one conversation must know of each other: costs after, state before, last."""
    alone = [F.lit(list(_END)).alias("after"), F.lit(_NOTHING).alias("state"), F.lit(True).alias("last")]
    several = cut_lineage(cut.filter("open").select(
        "place", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n")).filter("n > 1").select("place"))
    if several.isEmpty():
        return cut.select("*", *alone)
    parts = cut.join(several, "place")
    # Contents that stood in an earlier piece are duplicates as well.
    every = parts.select("conv_id", "place", F.posexplode("contents").alias("at", "content"))
    earlier = F.min("place").over(Window.partitionBy("conv_id", "content"))
    again = every.withColumn("first", earlier).filter("place > first").groupBy("place").agg(
        F.collect_list("at").alias("again"))
    marked = cut_lineage(_mapped(
        parts.join(again, "place", "left").select("conv_id", "place", "marks", "again"), _mark_again,
        f"conv_id {dict(cut.dtypes)['conv_id']}, place bigint, marks binary, matrix array<bigint>"))
    told = cut_lineage(marked.select("conv_id", "place", "matrix").groupBy("conv_id").applyInArrow(
        _costs_after, "place bigint, after array<bigint>, last boolean"))
    ends = cut_lineage(_mapped(marked.join(told, "place").select("conv_id", "place", "marks", "after", "last"), _ends,
                               f"conv_id {dict(cut.dtypes)['conv_id']}, place bigint, ends array<int>"))
    begun = ends.groupBy("conv_id").applyInArrow(_states_before, "place bigint, state int")
    known = cut_lineage(marked.select("place", F.col("marks").alias("all_marks")).join(told, "place").join(begun, "place"))
    return cut.join(known, "place", "left").select(
        *[F.coalesce("all_marks", "marks").alias("marks") if c == "marks" else F.col(c) for c in cut.columns],
        *[F.coalesce(name, value).alias(name) for name, value in zip(("after", "state", "last"), alone, strict=True)])


def _mark_again(conv, place: int, marks: bytes, again: list[int] | None) -> dict:
    found = bytearray(marks)
    for at in again or ():
        if found[at] < 4 * _BLANK:
            found[at] = found[at] % 4 + 4 * _DUPLICATE
    matrix = piece_matrix(bytes(found))
    return {"conv_id": conv, "place": place, "marks": bytes(found), "matrix": [x for row in matrix for x in row]}


def _costs_after(table: pa.Table) -> pa.Table:
    """Costs to come behind each piece of a conversation: a suffix scan over their matrices."""
    rows = sorted(zip(table["place"].to_pylist(), table["matrix"].to_pylist(), strict=True), reverse=True)
    after, found = _END, []
    for i, (place, flat) in enumerate(rows):
        found.append({"place": place, "after": list(after), "last": i == 0})
        after = _onward(tuple(tuple(flat[4 * k:4 * k + 4]) for k in range(4)), after)
    return pa.Table.from_pylist(found, schema=pa.schema(
        [("place", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())]))


def _ends(conv, place: int, marks: bytes, after: list[int], last: bool) -> dict:
    """The state behind a piece for each state before it."""
    return {"conv_id": conv, "place": place, "ends": [unroll(marks, tuple(after), state, last)[1] for state in range(4)]}


def _states_before(table: pa.Table) -> pa.Table:
    state, found = _NOTHING, []
    for place, ends in sorted(zip(table["place"].to_pylist(), table["ends"].to_pylist(), strict=True)):
        found.append({"place": place, "state": state})
        state = ends[state]
    return pa.Table.from_pylist(found, schema=pa.schema([("place", pa.int64()), ("state", pa.int32())]))


_EDITED = ("conv_id {conv}, place bigint, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, "
           "illegal bigint, head int, tail int, low {turn}, high {turn}, n_turns bigint, "
           "kept array<struct<inserted:boolean,role:string,turn:{turn},content:binary>>")


def _edited(conv, place: int, open_: bool, marks: bytes, turns: list, roles: list[str], contents: list[bytes],
            after: list[int], state: int, last: bool) -> dict:
    """The edits of a piece and what its rows add to the counts of their conversation."""
    audit, _ = unroll(marks, tuple(after), state, last)
    kept, at, cost = [], 0, 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            kept.append({"inserted": True, "role": _ROLES[state], "turn": None, "content": None})
            cost += _INSERT
            continue
        if edit == "D":
            cost += _DELETE
        else:
            cost += (_RETYPE if edit == "R" else 0) + (_TRUNCATED if marks[at] // 4 == _CUT_OFF else 0)
            state = _NEXT[state] if edit == "R" else _kept_state(marks[at], state)
            kept.append({"inserted": False, "role": _ROLES[state] if edit == "R" else roles[at], "turn": turns[at],
                         "content": contents[at]})
        at += 1
    known = [turn for turn in turns if turn is not None]
    faults = [mark // 4 for mark in marks]
    return {"conv_id": conv, "place": place, "audit": audit, "cost": cost, "blank": faults.count(_BLANK),
            "duplicate": faults.count(_DUPLICATE), "truncated": faults.count(_CUT_OFF),
            "illegal": sum((a % 4, b % 4) not in _LEGAL for a, b in zip(marks, marks[1:])),
            "head": marks[0] % 4, "tail": marks[-1] % 4, "low": known[0] if known else None,
            "high": known[-1] if known else None,
            "n_turns": sum(a != b for a, b in zip(known, known[1:])) + bool(known), "kept": kept}


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def edits(turns: DataFrame, size: int = PIECE) -> DataFrame:
    """The repair of every conversation in pieces, as a written table; `audits` and `repaired` read it.

    `turns` has conv_id, turn, role and text. Rows of a conversation are taken by turn, nulls first; those of one turn
    by role and text digest, so that rows alike stand together. Null roles and texts count as one space, a null
    conv_id is a conversation of its own. Faults are judged in this order: blank (nothing but ASCII white space),
    duplicate (role and text seen earlier in the conversation), truncated (the last character that is not white space
    is none of .!?). A role with another initial than s, u and a, or none, cannot be kept. Empty and very long texts
    need nothing special, other columns are not looked at, and an empty table has no edits.
    """
    kinds = dict(turns.dtypes)
    schema = _EDITED.format(conv=kinds["conv_id"], turn=kinds["turn"])
    return cut_lineage(_mapped(_settled(pieces(_without_nulls(turns), size)), _edited, schema))


def audits(edited: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit for each conv_id of `conversations`.

    Those without rows have zeros and an empty audit.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "n_turns"]
    none = conversations.select("conv_id").distinct().select(
        "conv_id", *[F.lit(None).cast(kind).alias(c) for c, kind in edited.dtypes if c not in ("conv_id", "kept")])
    part = F.when(F.col("place").isNotNull(), F.struct("place", "audit", "head", "tail", "low", "high"))
    summed = edited.drop("kept").union(none.select(*edited.drop("kept").columns)).groupBy("conv_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.min("low").alias("least"), F.max("high").alias("most"), F.sort_array(F.collect_list(part)).alias("parts"))
    # Between neighbouring pieces: a change of roles, and a turn that both count.
    before, behind = F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), F.slice("parts", 2, F.size("parts"))
    breaks = F.zip_with(before, behind, lambda x, y: F.when(functools.reduce(
        lambda p, q: p | q, [(x["tail"] == a) & (y["head"] == b) for a, b in sorted(_LEGAL)]), 0).otherwise(1))
    shared = F.zip_with(before, behind, lambda x, y: F.when(x["high"] == y["low"], 1).otherwise(0))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda x, y: x + y)

    gaps = F.col("most") - F.col("least") + 1 - (F.col("n_turns") - total(shared))
    return summed.select(
        "conv_id", F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + total(breaks)).cast("bigint").alias("illegal"), "cost",
        F.array_join(F.transform("parts", lambda x: x["audit"]), "").alias("audit"))


def repaired(edited: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, place, at, role and text of the repaired conversations, which place and at put in order.

    Inserted rows have an empty text.
    """
    rows = edited.select("conv_id", "place", F.posexplode("kept").alias("at", "row")).select(
        "conv_id", "place", "at", "row.*")
    sources = _without_nulls(turns).withColumn("content", _content()).groupBy(_row_key().alias("row_key")).agg(
        F.any_value("text").alias("text"))
    kept = rows.filter("NOT inserted").withColumn("row_key", _row_key()).join(sources, "row_key")
    columns = ["conv_id", "place", "at", "role"]
    return kept.select(*columns, "text").union(
        rows.filter("inserted").select(*columns, F.lit("").alias("text")))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: the hex sha256 of `role:text`, joined by newlines, of all rows of a conversation.

    A sha256 runs through its bytes in order, so the rows of one conversation pass one task; it holds one batch of
    them at a time, sorted by Spark.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            ids, found = [], []
            for this, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is not None and this == conv:
                    state.update(b"\n")
                else:
                    if state is not None:
                        ids.append(conv)
                        found.append(state.hexdigest())
                    conv, state = this, hashlib.sha256()
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.string())],
                                             names=["conv_id", "repaired_sha256"])
            kind = batch.schema.field(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])],
                                             names=["conv_id", "repaired_sha256"])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", "at")
    lines = ordered.select("conv_id", F.concat("role", F.lit(":"), "text"))
    return lines.mapInArrow(digest, f"conv_id {dict(rows.dtypes)['conv_id']}, repaired_sha256 string")
