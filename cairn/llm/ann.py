"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions by random rotations that favour directions in which the vectors vary, shifted and
quantised; a Hilbert curve orders them. There are several such orderings. Each is cut into zones of about equal size at
splitters from sampled keys, zones are dealt to tasks, and a query goes to its own zone and its neighbours on the curve. There
its exact distances to all vectors of the window are taken in blocks, the best of each zone are kept, and windows of all
curves merge and rerank.

The model (centre, scales, rotations) is fitted on at most `sample` vectors, splitters on as many keys or eight a zone; every
vector is indexed. A zone holds `share` of all vectors, at least `least` and at most `most` of them: up to most / share vectors
(5.5 million) the windows keep their share, which vectors without any structure need for a recall of 0.9; beyond, a query meets
at most 3 x curves x most vectors, however many there are, and what a task holds stays the same.
Of equal vectors only the k + 1 with the smallest ids can be among anyone's k nearest, so no more are indexed, and equal
queries are searched once: a vector that a third of the table repeats costs as much as any other.

Null vectors, vectors of zeros, with null or non-finite components, of another length than the most frequent one, or
without an id take no part. An id that repeats keeps its smallest vector. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, stored

CURVES = 24
DIMENSIONS = 8
BITS = 4
SHARE = 0.012
LEAST, MOST = 512, 65536
SAMPLE = 16384
#: Neighbours that a zone's window has on either side.
SIDES = 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with `bits` bits a coordinate (after Skilling's transform)."""
    x = [c.astype(np.uint64) for c in cells.T]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        mask = q - one
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & mask)
            x[0] = np.where(on, x[0] ^ mask, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip = np.where((x[-1] & q) != 0, flip ^ (q - one), flip)
    x = [c ^ flip for c in x]
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = key << one | (c >> np.uint64(level) & one)
    return key


@dataclass
class Curves:
    centre: np.ndarray
    turns: list[np.ndarray]  # of each curve: dimensions x projected
    scales: list[np.ndarray]
    shifts: list[np.ndarray]
    splitters: list[np.ndarray]  # of each curve, empty until they are sampled

    def keys(self, vectors: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        """Place on a curve; the fraction, from the id, parts vectors with one key into several zones evenly."""
        at = (vectors - self.centre) @ self.turns[curve] / self.scales[curve]
        cells = np.clip(((at + 0.5) * 0.5 + self.shifts[curve]) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(curve)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return hilbert(cells, BITS).astype(float) + (x >> np.uint64(44)).astype(float) / (1 << 20)

    def zones(self, vectors: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.splitters[curve], self.keys(vectors, ids, curve), "right")


def fit(vectors: np.ndarray, curves: int = CURVES, seed: int = 17) -> Curves:
    """Rotations, scales and shifts. Directions are drawn with the covariance of the vectors, so that those of little variance are rare; where all vary alike, as any rotation would be."""
    rng = np.random.default_rng(seed)
    width = vectors.shape[1]
    m = min(DIMENSIONS, width)
    out = Curves(vectors.mean(axis=0), [], [], [], [])
    apart = vectors - out.centre
    apart = apart / max(np.abs(apart).max(), 1e-300)
    value, vector = np.linalg.eigh(apart.T @ apart / len(vectors) + 1e-12 * np.eye(width))
    root = vector * np.sqrt(np.maximum(value, 1e-6 * value.max()))
    while len(out.turns) < curves:
        turn = np.linalg.qr(root @ rng.normal(size=(width, min(width, 8 * m))))[0]
        for i in range(0, turn.shape[1] - m + 1, m):
            if len(out.turns) == curves:
                break
            out.turns.append(turn[:, i : i + m])
            spread = ((vectors - out.centre) @ out.turns[-1]).std(axis=0)
            out.scales.append(6 * np.maximum(spread, 1e-12))
            out.shifts.append(rng.random(m) * 0.5)
    return out


def split(rows: DataFrame, model: Curves, zones: int, every: int, width: int) -> list[np.ndarray]:
    """Splitters of each curve into `zones` zones, by the keys of one in `every` of rows(id, v), chosen by hash. Only splitters go to the driver."""
    if zones == 1:
        return [np.zeros(0) for _ in model.turns]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            ids, v = b.column("id").to_numpy(), b.column("v").flatten().to_numpy().reshape(-1, width)
            for c in range(len(shared.value.turns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c, np.int32)), pa.array(shared.value.keys(v, ids, c))], names=["curve", "key"])

    keys = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", "v").mapInArrow(run, "curve int, key double")
    cuts = keys.groupBy("curve").agg(F.percentile_approx("key", [i / zones for i in range(1, zones)], max(10_000, 20 * zones)).alias("cuts")).collect()
    found = {r["curve"]: np.array(r["cuts"]) for r in cuts}
    return [found.get(c, np.zeros(0)) for c in range(len(model.turns))]


def nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest vectors of each query; distances of what may be among them are taken anew from differences."""
    found = []
    norm = (vectors**2).sum(axis=1)
    step = max(1, 2_000_000 // max(len(vectors), 1))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        near = (q**2).sum(axis=1)[:, None] + norm[None] - 2 * q @ vectors.T
        if k < near.shape[1]:
            bar = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
            row, col = np.nonzero(near <= bar + 1e-9 * (1 + np.abs(bar)))
        else:
            row, col = map(np.ravel, np.indices(near.shape))
        exact = np.sqrt(((q[row] - vectors[col]) ** 2).sum(axis=1))
        by = np.lexsort((ids[col], exact, row))
        row, col, exact = row[by], col[by], exact[by]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < k
        found.append((row[keep] + i, ids[col[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine)
    return rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v.cast("array<double>")).alias("v"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, curves: int = CURVES, share: float = SHARE, least: int = LEAST, most: int = MOST, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which is_query (over the column `id`) holds, among all rows but itself; score is the Euclidean distance."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = stored(usable(vectors, id_col, vector_col))
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    width, n = widths[0]["w"], widths[0]["n"]
    rows = rows.where(F.size("v") == width)
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    zones = max(1, n // min(max(least, math.ceil(share * n)), most))
    found = fit(np.array([r["v"] for r in few]), curves)
    found.splitters = split(rows, found, zones, max(1, n // max(sample, 8 * zones)), width)
    model = spark.sparkContext.broadcast(found)
    # Of equal vectors the k + 1 smallest ids; equal queries once, under their smallest id.
    alike = Window.partitionBy("v").orderBy("id")
    indexed = rows.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1).select("id", "v")
    asked = rows.where(is_query)
    heads = asked.groupBy("v").agg(F.min("id").alias("head"))

    def deal(kind: int):
        reach = 0 if kind else SIDES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 4096):
                ids = b.column("id").to_numpy()
                v = b.column("v").flatten().to_numpy().reshape(-1, width)
                raw = pa.array([x.tobytes() for x in v], pa.binary())
                for c in range(len(model.value.turns)):
                    own = model.value.zones(v, ids, c)
                    for by in range(-reach, reach + 1):
                        to = own + by
                        at = np.flatnonzero((to >= 0) & (to < zones))
                        yield pa.RecordBatch.from_arrays([pa.array(c * zones + to[at]), pa.array(np.full(len(at), kind, np.int32)), b.column("id").take(pa.array(at)), raw.take(pa.array(at))], names=["zone", "kind", "id", "v"])

        return run

    dealt = "zone long, kind int, id long, v binary"
    both = heads.select(F.col("head").alias("id"), "v").mapInArrow(deal(0), dealt).unionByName(indexed.mapInArrow(deal(1), dealt))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            zone, kind, ids = (t.column(c).to_numpy() for c in ("zone", "kind", "id"))
            v = np.frombuffer(b"".join(t.column("v").to_pylist()), float).reshape(-1, width)
            cut = np.flatnonzero(np.r_[True, zone[1:] != zone[:-1]])
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(zone)]):
                mid = a + int((kind[a:b] == 0).sum())
                if a < mid < b:
                    q, found, score = nearest(v[a:mid], v[mid:b], ids[mid:b], k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:mid][q]), pa.array(found), pa.array(score)], names=["head", "vec_id", "score"])

        for b in batches:
            held.append(b)
            zone = b.column("zone")
            if b.num_rows and zone[0] != zone[b.num_rows - 1] or len(held) > 1 and held[0].column("zone")[0] != zone[0]:
                t = pa.Table.from_batches(held)
                zone = t.column("zone").to_numpy()
                at = int(np.flatnonzero(zone != zone[-1])[-1]) + 1
                yield from done(t.slice(0, at))
                held = t.slice(at).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    parts = min(curves * zones, 4 * partitions(spark))
    near = both.repartition(parts, "zone").sortWithinPartitions("zone", "kind").mapInArrow(rerank, "head long, vec_id long, score double").distinct()
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).select("head", "vec_id", "score")
    pairs = asked.join(heads, "v").select(F.col("id").alias("query_id"), "head").join(best, "head").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
