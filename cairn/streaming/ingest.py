"""Streaming ingestion: files to chunks to an idempotent table, resumable from its checkpoint; document states from events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.chunking import assemble, window_chunks


def chunk_stream(spark: SparkSession, source: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """A stream of rows (id, source, text) from Parquet files as they arrive, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)


def upsert_batches(target: str, key: str = "chunk_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is written under its number, overwriting what an earlier try left, so that a replay changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def read_latest(spark: SparkSession, target: str, key: str = "chunk_id") -> DataFrame:
    """The table: of each key the row of the last batch."""
    rows = spark.read.parquet(target)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).dropDuplicates([key])


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, per_trigger: int = 64) -> StreamingQuery:
    """Start a query that takes what is there (availableNow) and ends; a later start takes up where it stopped."""
    files = chunk_stream(spark, source, schema, per_trigger)

    def write(batch: DataFrame, number: int) -> None:
        chunks = window_chunks(batch.select("id", "text")).join(batch.select("id", "source"), "id")
        upsert_batches(target)(assemble(chunks, F.lit("repo"), F.concat_ws("/", "source", F.col("id").cast("string"))), number)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def state_stream(events: DataFrame, key: str = "document", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """(document, started, ended, confirmed, expected, failed), one row for each run over a document: events no further apart than `late`.

    The watermark follows `at` by the same time, so that a run's state is dropped once nothing more can join it; completion()
    gives the status, whatever order two writers come in.
    """
    runs = events.withWatermark(at, late).groupBy(F.session_window(at, late).alias("run"), key)
    counted = runs.agg(F.count_if(F.col("kind") == "confirmed").alias("confirmed"), F.max(F.when(F.col("kind") == "expected", F.col("n"))).alias("expected"), F.count_if(F.col("kind") == "failed").alias("failed"))
    return counted.select(key, F.col("run.start").alias("started"), F.col("run.end").alias("ended"), "confirmed", "expected", "failed")


def metered(rows: DataFrame, name: str, tokens: str = "token_count", failed: str = "failed") -> DataFrame:
    """Rows as they are, observed under `name`: counts of rows, failures and tokens, which a batch gives through an Observation and a stream through its progress."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(failed)).alias("failed"), F.sum(tokens).alias("tokens"))
