from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest table of documents, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, a missing id twice."""
    long = " ".join(f"wort{i % 977} und" for i in range(60_000))
    same = "the same words stand in this line here\nand another line that is shared by both texts"
    rows = [
        (1, None, "en", "s", 0),
        (2, "", None, None, None),
        (3, " \t\n\r\x0b\x0c", "en", "s", 6),
        (4, same, "en", "s", 80),
        (5, same, "de", "s", 80),
        (5, same, "de", "s", 80),
        (6, same.upper() + " \nplus", "en", None, 90),
        (7, "żółw 漢字 😀 ▁ \x00 end", "fr", "s", 20),
        (8, long, "de", "s", len(long)),
        (8, "a second text under an id that is in use", "de", "s", 40),
        (None, same, "en", "s", 80),
        (None, None, None, None, None),
        (9, "12345 67890 !!!", None, "s", 15),
        (-3, "kurz", "de", "s", 4),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
