"""A corpus pipeline of five stages. Each stage takes (spark, docs, sf_dir) and gives the next one's docs; the last gives packed sequences.

Null texts count as empty: they are not toxic, are copies of other texts without words (the one with the smallest id stays), and
stay null or become empty where nothing is in them to remove. Equal ids do not make two rows one; of rows that repeat, ids
and texts alike, one stays. Of near copies with one id the first row read stays. Null ids come after all others. Empty tables
give empty tables, and columns beside those used, whatever their names, are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import stored, table
from cairn.llm.packing import pack
from cairn.llm.queries import fold
from cairn.llm.secrets import redact
from cairn.llm.shingles import one_of_each
from cairn.llm.suffix_dedup import remove_repeats
from cairn.llm.toxicity import fit, reject


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return reject(docs, fit(docs, table(spark, sf_dir, "labels"), learn=fold(3) != 1), least=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; texts link at 0.8 of their five-word shingles."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What 51 successive words cover that also stand elsewhere goes; so do, in all texts, bytes covered by a repeated string of 400 bytes, which fewer words may fill. n_chars follows. All documents stay, if with empty text."""
    own = lambda c: f"_cairn_{c}"  # noqa: E731  so that no column of a document is taken for one of the operator's
    out = remove_repeats(docs.toDF(*map(own, docs.columns)), length=400, id_col=own("doc_id"), text_col=own("text"), keep=[own(c) for c in docs.columns], keep_text=True, words=51)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*(made.get(c, F.col(own(c))).alias(c) for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows. All documents stay."""
    return redact(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids in sequences of at most 2048."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, separator=0)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packing),
]

#: Learning, components and packing are not SQL; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
