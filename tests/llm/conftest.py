"""Small awkward document tables."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, rid long, key string, size string"


@pytest.fixture
def table(spark):
    """rows (doc_id, text, source) as documents with extra columns whose names clash with what operators make."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, False, 7, "k", "x") for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture
def awkward(table):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    words = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g", "s1"), (1, "a b c d e f g", "s1"), (2, "", "s2"), (3, None, None), (None, "null id text here", "s1"), (4, words, "s3"),
        (5, words + " end", "s3"), (6, " \n\t ", None), (7, "ÄÖ ß 日本 😀 ▁x", "S"), (8, "a b c d e f g", "s2"), (None, None, None),
    ]
    return table(rows)


@pytest.fixture
def empty(table):
    return table([])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
