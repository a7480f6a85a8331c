"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.tables import TEXT_BATCH, TEXT_BYTES, slices, spread, text_batches  # noqa: F401


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null: str | None = "") -> DataFrame:
    """(doc_id, text) alone: other columns, whatever their names, are pruned at the scan; null texts count as empty."""
    text_batches(docs.sparkSession)
    body = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (body if null is None else F.coalesce(body, F.lit(null))).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in one small file are dealt over all cores, other tables are read as their splits are."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session names it. A folder of this machine is made only where none is named and the master is local; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder, so that a lost executor costs a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed(), but as compressed Parquet, read back with column pruning. The folder goes with forget(), or when the driver ends."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/cairn-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove the folders of frames from stored() that nothing reads any more."""
    for f in frames:
        fs, folder = _folder(f.sparkSession, f.stored_at)
        fs.delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): one row (node, root) for each node that has an edge, root the smallest node reachable.

    Alternating large-star and small-star rounds; every round is a shuffle of at most the edges, cut by checkpoint().
    A round's fingerprint (two sums) goes to the driver, never nodes or edges; joins are merges, as a checkpoint keeps the size that
    was guessed for its plan, which after a Python pass is too low.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = checkpointed(small)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
