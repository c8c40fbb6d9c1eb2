import os
import sys

import pytest
from pyspark import cloudpickle

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import changeflow  # noqa: E402

cloudpickle.register_pickle_by_value(changeflow)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows, schema=SCHEMA):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def odd():
    """Nulls, blanks, ties, repeated rows, a null id, a very long text."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one two three four five six seven"),
        (4, "one two three four five six seven"),
        (5, "one two three four five six seven"),
        (None, "a text without an id"),
        (6, "x"),
        (7, "äöü ß € 日本語 <|endoftext|> # | * done"),
        (8, "long words and lines\n" * 3000),
        (9, "y" * 5000),
    ]
