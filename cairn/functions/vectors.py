"""Vectors as array columns: dot products, pooling, normalising, and a deterministic embedder for tests and offline use."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: below this norm a vector is left as it is.
SMALL_NORM = 1e-8


def dot(a: Column, b: Column) -> Column:
    """In double precision; an error where the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors differ in length")))


def normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > SMALL_NORM, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def mean_pool(rows: DataFrame, by: str, vector: str, mask: str) -> DataFrame:
    """(by, v): the unit vector along the mean of the rows with mask 1, one place at a time."""
    each = rows.where(F.col(mask) == 1).select(by, F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(by, "i").agg(F.avg("x").alias("x"))
    return mean.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs")).select(by, normalise(F.transform("xs", lambda p: p["x"])).alias("v"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def embed(rows: DataFrame, id_col: str, text_col: str, encode: Callable[[list[str]], np.ndarray], size: int) -> DataFrame:
    """(id, v): extension point for a dense model; encode gets the texts of an Arrow batch and gives a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(encode([t or "" for t in b.column("text").to_pylist()]), np.float32).reshape(b.num_rows, size)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "v"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, v array<float>")


def hashing_encoder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed hashed words, unit length."""

    def encode(batch: list[str]) -> np.ndarray:
        out = np.zeros((len(batch), size))
        for i, text in enumerate(batch):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > SMALL_NORM)

    return encode
