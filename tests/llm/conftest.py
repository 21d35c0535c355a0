from __future__ import annotations

import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, blank, very long and repeated texts, and columns that clash with helper names."""
    texts = ["One two three four five.", None, "", " \n\t", LONG, "One two three four five.", "é ñ 🙂\nline\r\nend  "]
    rows = [(i if i != 5 else 0, t, "x", i, "c") for i, t in enumerate(texts)]
    rows += [(None, "no id here", "x", 9, "c"), (0, "One two three four five.", "x", 9, "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, h string, key int, component string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
