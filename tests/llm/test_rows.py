"""One row of each component is chosen by row, not by id."""

import random
from collections import Counter

import pytest


@pytest.mark.parametrize("module", ["simhash", "shingles"])
def test_rows_not_ids(spark, module):
    """Different texts stay apart whatever their ids; a copy goes whatever its id."""
    import importlib

    rng = random.Random(5)
    text = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 9) for _ in range(80)) for _ in range(4)]
    rows = [(None, text[0], 0), (None, text[1], 1), (None, text[1], 2), (7, text[2], 3), (7, text[3], 4), (3, text[3], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = Counter((r["doc_id"], r["text"]) for r in importlib.import_module(f"cairn.llm.{module}").one_of_each(docs).select("doc_id", "text").collect())
    assert got == Counter([(None, text[0]), (None, text[1]), (7, text[2]), (3, text[3])])
