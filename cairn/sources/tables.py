"""Reading tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows, and bytes, that a worker turns into Python objects at a time.
TEXT_BATCH = 256
TEXT_BYTES = 2 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores: a table that comes in fewer parts than there are cores (one small file) is dealt anew; any other is left as its splits are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def text_batches(spark: SparkSession, size: int = TEXT_BYTES) -> None:
    """Bound the bytes that one Arrow batch brings to a worker, so that long texts cannot fill it. How many rows a batch may have stays as the session has it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(filter(str.isdigit, spark.conf.get(key))) or 0)
    if now <= 0 or now > size:
        spark.conf.set(key, str(size))


def slices(batches: Iterable[pa.RecordBatch], rows: int = TEXT_BATCH, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into parts of at most `rows` rows and about `size` bytes (one row at least). The session's settings stay as they are."""
    for b in batches:
        step = max(1, min(rows, int(size * b.num_rows / max(b.nbytes, 1)))) if b.num_rows else 1
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
