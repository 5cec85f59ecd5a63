from __future__ import annotations

import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Extra columns whose names the operators use inside.
CLASHING = ("size", "key", "hash", "bucket", "target", "n_shingles", "set_id", "text_a", "path", "score", "row", "vslot")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(words: int, seed: int, alphabet: str = LETTERS) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 8))) for _ in range(words))


def rows_of(texts) -> list[tuple]:
    """(doc_id, text) pairs, or (doc_id, text, lang, source), as rows of documents."""
    out = []
    for row in texts:
        doc_id, text, lang, source = (*row, None, None)[:4] if len(row) < 4 else row
        out.append((doc_id, text, lang, source, None if text is None else len(text), *(["x"] * len(CLASHING))))
    return out


@pytest.fixture
def docs_of(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


#: Nulls everywhere, empty, blank, tiny, very long, repeated and non-ASCII texts, repeated and null ids.
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "word", "en", None), (5, "12 34 !!", "en", "b"),
    (6, prose(30_000, 1), "en", "b"), (7, prose(60, 2), None, "a"), (7, prose(60, 2), None, "a"), (8, prose(60, 2), "en", "c"), (9, "Größe ñandú 東京 " * 40, "de", "c"),
    (None, prose(60, 2), "en", "a"), (None, None, None, None), (10, prose(300, 3), "en", "a"), (11, "x" * 3000, "en", "a"), (12, "ab" * 700, "fr", "a"),
]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def none(docs_of):
    return docs_of([])
