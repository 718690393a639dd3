from __future__ import annotations

import pytest


@pytest.fixture
def frame(spark):
    def of(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return of


#: A null, empty and blank texts, ties, a repeated row, a null id, a very long text, symbols.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (5, "a b c"), (4, "a b c"), (None, "a b c"), (6, "word " * 30_000), (7, "é ß 漢字 🙂 ### !!!"), (8, "x" * 50_000)]
