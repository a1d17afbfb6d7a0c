"""Conversation repair against a search over all edits, and its damage against a row-by-row model."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest_llm import rows_of

from filecensus.llm import conversations
from filecensus.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        dice = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if dice == 1:
            text = ""
        elif dice == 2:
            text = re.sub("[.!?]", "", text)
        elif dice == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (dice != 0) * (1 + (dice == 3))


def cheapest(rows):
    """Cost, audit and repaired rows, by relaxing (row, state) until nothing gets cheaper."""
    states = ["", "s", "u", "a"]

    def after(state, initial):
        if initial == "s":
            return "s" if state == "" else None
        if initial == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if initial == "a" and state == "u" else None

    best = {(len(rows), state): (0, "", ()) for state in ("", "a")}
    for i in range(len(rows), -1, -1):
        for _ in range(6):
            for state in states:
                options = [best[(i, state)]] if (i, state) in best else []

                def take(cost, edit, j, new, row, options=options):
                    if new is not None and (j, new) in best:
                        c, e, kept = best[(j, new)]
                        options.append((cost + c, edit + e, (() if row is None else (row,)) + kept))

                if i < len(rows):
                    role, text, fault = rows[i]
                    take(4, "D", i + 1, state, None)
                    if fault not in ("blank", "duplicate"):
                        extra = 3 * (fault == "truncated")
                        take(extra, "K", i + 1, after(state, role[:1]), (role, text))
                        for other in ("user", "assistant"):
                            take(3 + extra, "R", i + 1, after(state, other[0]), (other, text))
                for other in ("user", "assistant"):
                    take(3, "I", i, after(state, other[0]), (other, ""))
                if options:
                    best[(i, state)] = min(options)
    return best[(0, "")]


def model(rows):
    found = {}
    for conv in {row[0] for row in rows}:
        mine = [row for row in damaged(row for row in rows if row[0] == conv)]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], _digest(r[2], r[3])))
        seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in mine:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not solid else "duplicate" if (role, text) in seen
                     else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [row[1] for row in mine if row[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, kept = cheapest(marked)
        sha = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in kept).encode()).hexdigest()
        found[conv] = (conv, gaps, *counts.values(), illegal, cost, audit, sha)
    return sorted(found.values(), key=repr)


def _digest(role, text):
    shown = "".join(f"{len(x.encode())}:{x}" for x in (role, text))
    return hashlib.md5(shown.encode()).digest()


def run(spark, rows, tmp_path, size=None, monkeypatch=None):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    if size:
        whole = conversations.edits
        monkeypatch.setattr(conversations, "edits", lambda turns: whole(turns, size))
    return rows_of(QUERIES["op11_run_length_repair"](spark, str(tmp_path)), *COLUMNS)


def random_rows(rng, conversations_, most):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "a", "u2"]
    texts = ["Yes.", "No!", "what", "", "  \n", "Same text?", "cut off", "é…", None, "end.\x85", "end. \n"]
    for conv in range(conversations_):
        for turn in range(rng.randint(1, most)):
            place = rng.choice([turn, turn, turn, turn, None, turn + 2])
            yield (conv if conv else None, place, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{turn}.")


def test_random_conversations(spark, tmp_path):
    rows = list(random_rows(random.Random(3), 60, 12))
    assert run(spark, rows, tmp_path) == model(rows)


@pytest.mark.parametrize("size", [1, 3])
def test_conversations_in_many_pieces(spark, tmp_path, monkeypatch, size):
    """One conversation holds most rows; its pieces must find each other's duplicates, costs and states."""
    rng = random.Random(size)
    rows = [*random_rows(rng, 6, 5), *[(99, rng.randint(0, 30), rng.choice(["user", "assistant", "system"]),
                                        rng.choice(["a.", "b", "", "c!"]) + str(rng.randint(0, 9)) + ".") for _ in range(40)]]
    assert run(spark, rows, tmp_path, size, monkeypatch) == model(rows)


def test_edges(spark, tmp_path):
    long = "word " * 200_000 + "."
    rows = [(1, 1, "user", long), (1, 2, "assistant", long), (2, None, None, None), (None, None, None, None),
            (3, 5, "assistant", "x."), (3, 5, "assistant", "x."), (4, 0, "system", "x."), (5, 2**40, "user", "x."),
            (5, 1, "user", "y.")]
    assert run(spark, rows, tmp_path) == model(rows)


def test_dropped_and_empty_tables(spark, tmp_path):
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = run(spark, [(gone, 0, "user", "x.")], tmp_path)
    assert found == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(spark, [], tmp_path) == []


def test_damage(spark):
    rows = list(random_rows(random.Random(8), 40, 8))
    found = conversations.damage(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(found, "conv_id", "turn", "role", "text") == sorted(damaged(rows), key=repr)


def test_powers_and_long_runs():
    rng = random.Random(1)
    for _ in range(200):
        marks = bytes(rng.choice([1, 2, 0, 5, 3, 9]) for _ in range(rng.randint(1, 5)) for _ in range(rng.randint(1, 40)))
        one_by_one = functools.reduce(conversations._product, map(conversations._step, marks))
        assert conversations.piece_matrix(marks) == one_by_one
        audit, state = conversations.unroll(marks, conversations._END, 0, True)
        assert audit.count("I") + len(marks) == len(audit) and state in (0, 3)


def test_clashing_columns(spark, tmp_path):
    rows = list(random_rows(random.Random(5), 8, 6))
    table = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", *[f"1 AS `{c}`" for c in ("place", "at", "content", "mark", "marks", "tie", "copy", "row_key", "audit", "kept")])
    edited = conversations.edits(conversations.damage(table))
    plain = conversations.edits(conversations.damage(table.select("conv_id", "turn", "role", "text")))
    assert rows_of(conversations.audits(edited, table), *COLUMNS[:-1]) == rows_of(
        conversations.audits(plain, table), *COLUMNS[:-1])
