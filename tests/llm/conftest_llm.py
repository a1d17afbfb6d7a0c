"""Small documents with everything that a table may hold."""

import random

import pytest

CLASHING = ("row", "node", "read_key", "key", "tokens", "n_tokens", "ids", "_row", "_faults", "_row_key", "spans",
            "size", "shard", "kept", "n", "label", "component", "words")


def odd_texts():
    """Null, empty, blank, long, repeated and awkward texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    base = prose(120)
    near = base.split()
    near[50] = "changed"
    return [
        None, "", " ", "\n", "a", "the same text twice over, word for word", "the same text twice over, word for word",
        passage + " " + prose(30), prose(25) + "\n" + passage, base, " ".join(near), base.upper(), "ab" * 3000,
        "x" * 500, "é" * 300, "日本語のテキスト。" * 40, "tabs\tand  spaces   run \n\n on", "\x00 nul and \x85 and \xa0",
        "<s> <|endoftext|> </s> <unk> <0x0A>", "▁ mark ▁▁ of space", "mail a.b@mail.example.com or 10.0.0.1",
        "call +1 (843) 555-7672 now", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "it's we'll don't 12 34 ½ Ⅷ",
        prose(4000), None, "", "🙂 emoji 👩‍👩‍👧 and ﬁ ligature", "word",
    ]


def as_docs(spark, texts, ids=None, extra=()):
    rows = [(i, text, "en", "src0", None if text is None else len(text)) + ("x",) * len(extra)
            for i, text in zip(ids or range(len(texts)), texts, strict=True)]
    names = "".join(f", `{name}` string" for name in extra)
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint" + names)


@pytest.fixture(scope="session")
def texts():
    return odd_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Odd texts with repeated and null ids, and columns whose names the operators use themselves."""
    return as_docs(spark, [*texts, "twin row", "twin row", "no id", "no id"],
                   [*range(len(texts)), 900, 900, None, None], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_docs(spark, [])


def rows_of(frame, *columns):
    return sorted((tuple(row) for row in frame.select(*columns).collect()), key=repr)
