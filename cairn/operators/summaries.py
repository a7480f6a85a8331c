"""The summary phase: what is pending, what the cache has, what a generator adds, and the breaker that stops it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.identity import group_hash

# Fixed value: failures in a row that open the breaker.
BREAKER = 10


def groups(chunks: DataFrame, per_file: bool) -> DataFrame:
    """(group_key, content) to summarise: each chunk by its content hash, or each (path, class) by the hash of its chunks' hashes."""
    if not per_file:
        return chunks.select(F.col("content_hash").alias("group_key"), "content").dropDuplicates(["group_key"])
    packed = chunks.groupBy("path", F.coalesce("class_name", F.lit("")).alias("class_name")).agg(group_hash(F.collect_list("content_hash")).alias("group_key"), F.sort_array(F.collect_list(F.struct("start_line", "content"))).alias("parts"))
    return packed.select("group_key", F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("content")).dropDuplicates(["group_key"])


def summarise(wanted: DataFrame, cache: DataFrame, version: str, generate: Callable[[str], str | None], breaker: int = BREAKER) -> DataFrame:
    """(group_key, version, summary, negative): new cache rows for groups that cache(group_key, version, ...) lacks.

    A generator that gives None leaves a negative row, so that it is not asked again; one that raises leaves none. Each partition stops after
    `breaker` failures in a row.
    """
    missing = wanted.join(cache.where(F.col("version") == version).select("group_key"), "group_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for b in batches:
            keys, texts = [], []
            for key, content in zip(b.column("group_key").to_pylist(), b.column("content").to_pylist()):
                if failed >= breaker:
                    break
                try:
                    made = generate(content)
                except Exception:
                    failed += 1
                    continue
                failed = 0
                keys.append(key)
                texts.append(made)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([version] * len(keys), pa.string()), pa.array(texts, pa.string()), pa.array([t is None for t in texts], pa.bool_())], names=["group_key", "version", "summary", "negative"])

    return missing.select("group_key", "content").mapInArrow(run, "group_key string, version string, summary string, negative boolean")
