import os
import sys

import pytest

from docfathom.llm.text import bound_batches

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import ODD  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, found string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns whose names the operators use, too."""
    bound_batches(spark)

    def build(rows, lang="en"):
        return spark.createDataFrame(
            [(i, t, lang, "src0", len(t or ""), "a", "b") for i, t in rows], SCHEMA
        ).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)
