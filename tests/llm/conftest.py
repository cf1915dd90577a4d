from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"

# Nulls in every column, empty and blank texts, repeats, ties, one long text, clashing extra columns.
AWKWARD = [
    (1, "one two three four five six", "en", "b", 27, 0.5, "x", 1),
    (1, "one two three four five six", "en", "b", 27, 0.5, "x", 1),
    (2, "one two three four five six", "en", "a", 27, 0.5, "x", 1),
    (3, "", "en", "a", 0, 0.5, "x", 1),
    (4, " \n\t ", "en", None, 4, None, None, None),
    (5, None, None, None, None, None, None, None),
    (None, "one two three four five six", None, "a", 27, None, None, None),
    (None, None, None, None, None, None, None, None),
    (6, "word " * 60_000, "en", "ä", 300_000, 0.1, "y", 2),
    (7, "ÀÉ ß 你好 😀 tail\x1cjoined same", "fr", "a", 25, 0.1, "y", 2),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, doc string, size int"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
