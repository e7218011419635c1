import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, fp string, hits string, component_id long, bucket int"


def as_docs(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns whose names operators use for their own."""
    out = []
    for r in rows:
        doc, text, lang, source = [*r, *[None] * (4 - len(r))]
        out.append((doc, text, lang, source, None if text is None else len(text), 7, "x", "y", 9, 1))
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture
def make(spark):
    return lambda rows: as_docs(spark, rows)


ODD = [
    (1, "One plain line.\nAnother line here."),
    (2, None),
    (3, ""),
    (None, "A row without an id.\nAnother line here."),
    (4, "  \t\n\x0b \r\n"),
    (5, "One plain line.\nAnother line here."),
    (5, "One plain line.\nAnother line here."),
    (6, "Ünï códe Kİſ 日本語 \U0001f600 ΣΑΣ don't x1 42"),
    (-7, "\x00\x1c\x85 a　b <|endoftext|> <|startoftext|>"),
    (8, "ha " * 30_000),
    (9, "y" * 70_000),
]


@pytest.fixture
def odd():
    return list(ODD)


def prose(rng: random.Random, words: int, vocabulary: list[str]) -> str:
    return " ".join(rng.choice(vocabulary) for _ in range(words))


@pytest.fixture
def vocabulary():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
