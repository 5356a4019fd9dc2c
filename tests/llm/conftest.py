from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row string"
# Null and empty texts, null labels, a repeated row, a repeated id, equal texts; score, fp and row clash with inner names.
ROWS = [
    (0, "One two three four five six seven eight nine ten.", "en", "src0", 49, 0.1, "x", "r"),
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "src1", 0, 0.2, "y", None),
    (3, "two words", "de", None, 9, None, None, None),
    (4, "One two three four five six seven eight nine ten.", "en", "src0", 49, 0.3, None, None),
    (4, "One two three four five six seven eight nine ten.", "en", "src0", 49, 0.3, None, None),
    (5, "é" * 70 + " \x0b\x0c café <|endoftext|> 日本 'll  \n", "fr", "other", 90, None, None, None),
    (5, "same id, another text", "fr", "src9", 21, None, None, None),
    (None, "no id at all", "es", "src3", 12, None, None, None),
    (7, "a " * 40_000, "en", "src0", 80_000, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
