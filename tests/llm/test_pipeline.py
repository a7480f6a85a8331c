"""The pipeline, stage by stage, against plain versions of what each decides."""

import re
from collections import Counter

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from cairn.llm import queries
from cairn.llm.common import stored, table
from cairn.llm.secrets import redact
from test_near import brute


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", None])
def test_stages(spark, corpus, folder):
    folder = folder or corpus[1]
    docs = table(spark, folder, "documents")
    if "n_chars" not in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text"))
    kept = [docs]
    for _, stage in C.STAGES[:-1]:
        out = stored(stage(spark, kept[-1], folder))
        assert out.columns == docs.columns
        kept.append(out)
    ids = lambda d: Counter(r[0] for r in d.select("doc_id").collect())
    toxic = queries.op2_toxicity(spark, folder) if "n_chars" in table(spark, folder, "documents").columns else None
    if toxic is not None:
        assert ids(kept[1]) == ids(toxic.where("predicted = 0"))
    # Of each group of near copies (five-word shingles, a Jaccard of 0.8) one row stays.
    at = sorted(((r["doc_id"], r["text"]) for r in kept[1].collect()), key=lambda r: r[0])
    heads = Counter(at[i][0] for i in brute([t for _, t in at]))
    assert ids(kept[2]) == heads
    assert ids(kept[3]) == ids(kept[2]) == ids(kept[4])
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept[4].collect())
    packed = C.STAGES[-1][1](spark, kept[4], folder).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in packed} == set(heads)


def test_odd_tables(spark):
    """Nulls, two texts under one id, no rows at all, and columns with the names that stages use inside."""
    rows = [(1, "some words of a text", "x", True), (1, "quite another text that differs", "y", False), (None, None, None, None), (2, "", "z", True), (3, "token=abcdefgh1 here", "w", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _gated boolean").selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) as n_chars", "_gated as gated", "'b' as blob", "1 as n_bytes", "2 as kept_text", "3 as start", "4 as node", "5 as spans")
    folder = "/root/testdata/sf0.001"
    for frame, n in ((docs, 5), (docs.limit(0), 0)):
        now = frame
        for _, stage in C.STAGES[:-1]:
            now = stored(stage(spark, now, folder))
            assert now.columns == frame.columns and now.count() == (n if n == 0 else 4 if _ != "toxicity" else 5)
        assert C.STAGES[-1][1](spark, now, folder).count() == (4 if n else 0)


def test_run(spark):
    got = C.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_redaction(spark):
    text = "a token=abcdefgh1 b " + "0123456789abcdef" * 2 + " secret='" + "deadbeef" * 4 + "' é😀 AKIA" + "Z" * 12 + " end"
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, None), (4, text)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert got[2] == "plain" and got[3] is None
    assert got[1] == got[4] == "a [secret] b [secret] [secret]' é😀 [secret] end"
    assert not re.search("deadbeef|abcdefgh1|AKIA", got[1])
