from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, digest string, locator long, key long, row string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the names that operators use inside."""
    long = " ".join(f"word{k % 97}x{k}" for k in range(20_000))
    rows = [(1, "Same  text here, with\tsix words"), (2, "Same text here, with six words"), (3, None), (4, ""), (5, " \n "), (None, "alone without an id"), (None, None), (7, long), (8, long), (9, "twice given"), (9, "twice given"), (10, "a"), (11, "é ß İ 漢字 🙂")]
    return spark.createDataFrame([(*r, "x", 0, 1, None) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
