from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"
CLASHING = "row string, score string, key int, label int, ids string, n string, target int, u int, vec int, tree int"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} under the mit license" for i in range(4000))
    rows = [
        (1, "the same text of six words", "en", "a"), (2, "the same text of six words", "en", "a"), (2, "the same text of six words", "en", "a"),
        (3, None, "en", "b"), (4, "", None, None), (5, " \t\n ", "fr", "b"), (6, long_text, "en", "a"), (7, "word", "de", None),
        (None, "a text without an id", "en", "a"), (None, None, None, None), (8, "ÀÉ ß ſ İ 中文 <|endoftext|> 🙂", "fr", "c"), (9, "x" * 5000, "en", "c"),
        (10, "12 34 ### !!", "en", "c"), (8, "another text with a repeated id", "de", "b"),
    ]
    return spark.createDataFrame(
        [(*r, "r", "s", 1, 2, "i", "n", 3, 4, 5, 6) for r in rows], f"doc_id long, text string, lang string, source string, {CLASHING}"
    ).cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
