"""Small documents with every odd case, and the generated tables."""

from __future__ import annotations

import pytest

LONG = "the quick brown fox number {} jumps over a lazy dog and "

ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one two three four five six seven"),
    (5, "one two three four five six seven"),
    (6, "".join(LONG.format(k) for k in range(3000))),
    (7, "Ünïcödé ▁ text 🙂 with  two blanks, and <|endoftext|> mail a.b@c.de +49 (30) 123-4567 1.2.3.4"),
    (None, "a row without id 4111 1111 1111 1111 and more"),
    (8, "x" * 1000),
    (9, "line\x00 with control \x0b and \x1f marks"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with extra columns named as operators name their results."""
    rows = [(i, t, "en", "web", len(t or ""), "mine", 0.5, 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, n long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def small(documents):
    """All documents of the smallest table, on the driver."""
    return documents.toPandas()
