"""Awkward rows for the operators on documents."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in each column, empty and very long texts, ties, and repeated rows."""
    long = " ".join(f"w{i % 977}é" for i in range(30_000))
    rows = [
        (1, "Alpha beta GAMMA", "en", "a", 16), (2, "alpha BETA gamma", "en", "a", 16), (3, "Älpha", "de", "b", 5), (4, "älpha", "de", "b", 5),
        (5, None, None, None, None), (6, "", "en", "a", 0), (None, "alpha beta gamma", "en", None, 1), (None, None, None, None, None),
        (7, long, "fr", "b", len(long)), (8, long, "fr", "b", len(long)), (9, " \t\n", "en", "c", 3), (10, "one two three\u00a0 four\n\nfive <|endoftext|> six", "en", "a", 9),
        (11, "repeat me", "en", "a", 9), (11, "repeat me", "en", "a", 9), (12, "\U0001f600 smile é", "en", "c", 8),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
