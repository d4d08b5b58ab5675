import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with the other columns and some that clash with inner names."""

    def make(rows):
        full = [(i, t, "en" if k % 2 else None, None, len(t) if t is not None else None, "x", None) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS + ", id string, gram string")

    return make
