import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents with clashing extra columns from (doc_id, text) pairs."""
    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS)
    return make


#: Nulls in every column, empty and blank texts, a repeated row, an equal text, a long text.
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "plain words in a row"), (4, "plain words in a row"), (None, "no id here"),
       (5, "plain words in a row"), (6, "word " * 20_000), (7, "é\u0000\U0001F600 ﬁ")]
