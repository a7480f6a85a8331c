"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code: the perfect Hamming code of 31 bits, covering radius 1, on each of two halves of
the fingerprint. Of two fingerprints that differ in at most 3 bits, one half differs in at most 1. A fingerprint goes to
every anchor within covering radius + 1 = 2 of each half (1 or 16 anchors), so both meet at the anchor nearest to either.
Fingerprints are compared within an anchor only, as distinct values; an anchor with very many of them is cut into tiles
(pairs of blocks), so that no task holds an unbounded group and no pair is lost. Each group gives the edges of a spanning
forest, never all pairs.

Texts without words have fingerprint zero and link like any other; nulls count as empty; rows that repeat a doc_id each give a row;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, slices, stored, texts

#: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Distinct fingerprints that one block of an anchor holds.
BLOCK = 4096
HALF = 31


def majority(raw: bytes) -> bytes:
    """8 bytes, most significant first, of values of eight bytes each: a bit is 1 if it is set in over half of them; zero for none."""
    bits = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for i in range(0, len(bits), 32768):
        count += np.unpackbits(bits[i : i + 32768], axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * count > len(bits)).tobytes()


def fingerprint(text: str, words: int = 3, seed: int = 42) -> bytes:
    """The majority of the XXH64 values of the word shingles."""
    cut = text.encode().translate(LOWER).split()
    if not cut:
        return bytes(8)
    joined = b" ".join(cut)
    ends = list(accumulate([len(w) + 1 for w in cut]))
    starts = [0, *ends]
    hashed = xxhash.xxh64_digest
    return majority(b"".join([hashed(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :] or ends[-1:])]))


def _code() -> tuple[np.ndarray, np.ndarray]:
    """Per byte and value the part of the syndrome; per syndrome the 16 flips of at most 2 bits that lead to a code word."""
    part = np.zeros((4, 256), np.int64)
    for k in range(4):
        for v in range(256):
            for j in range(8):
                if v >> j & 1 and 8 * k + j < HALF:
                    part[k, v] ^= 8 * k + j + 1
    flips = np.zeros((32, 16), np.int64)
    for s in range(1, 32):
        pairs = [(c, c ^ s) for c in range(1, 32) if c < c ^ s and c ^ s]
        flips[s] = [1 << s - 1, *((1 << a - 1) | (1 << b - 1) for a, b in pairs)]
    return part, flips


PART, FLIPS = _code()


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors to which uint64 fingerprints go; an anchor is half << 31 | code word."""
    rows, keys = [], []
    for half in (0, 1):
        x = (prints >> np.uint64(HALF * half)).astype(np.int64) & (1 << HALF) - 1
        s = PART[0, x & 255] ^ PART[1, x >> 8 & 255] ^ PART[2, x >> 16 & 255] ^ PART[3, x >> 24]
        near = x[:, None] ^ FLIPS[s]
        use = np.ones(near.shape, bool)
        use[s == 0, 1:] = False  # a code word has no other within 2
        rows.append(np.nonzero(use)[0])
        keys.append(near[use] | half << HALF)
    return np.concatenate(rows), np.concatenate(keys)


def forest(prints: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest over distinct fingerprints that link within `distance` bits: what is reached leaves the set, so that dense groups shrink fast."""
    left, a, b = np.arange(1, len(prints)), [], []
    queue = [0] if len(prints) else []
    while queue:
        at = queue.pop()
        near = np.bitwise_count(prints[left] ^ prints[at]) <= distance
        if near.any():
            got = left[near]
            a += [at] * len(got)
            b += got.tolist()
            queue += got.tolist()
            left = left[~near]
        if not queue and len(left):
            queue, left = [int(left[0])], left[1:]
    return a, b


def prints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fingerprints of whole texts as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = b"".join(fingerprint(t, words, seed) for t in b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that span every component of the distinct fingerprints fp under `distance` <= 3."""
    if distance > 3:
        raise ValueError("the covering holds for at most 3 differing bits")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 8192):
                part = fp[i : i + 8192]
                row, key = anchors(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(key)])
            two = first[size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            a, b = [fp[near]], [fp[near + 1]]
            for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                i, j = forest(fp[at : at + n], distance)
                a.append(fp[at : at + n][i]), b.append(fp[at : at + n][j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "low", "high")], axis=1)
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if held:
                key, fp = np.concatenate([held[0][0], key]), np.concatenate([held[0][1], fp])
            # The last group may go on in the next batch.
            cut = len(key) - 1
            last = np.flatnonzero((key[:-1] != key[1:]).any(axis=1)) if cut > 0 else []
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [(key[cut:], fp[cut:])]
            yield solve(key[:cut], fp[:cut])
        if held:
            yield solve(*held[0])

    spread = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long")
    crowd = spread.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes what a Python pass gives by the rows that go in, 31 times too low here, and would broadcast it.
    met = spread.join(crowd.hint("merge"), "anchor").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    tiles = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("anchor", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    by = ["anchor", "low", "high"]
    return tiles.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links of at most `distance` bits."""
    own = stored(prints(docs, words, seed, id_col, text_col))
    heads = stored(own.groupBy("fp").agg(F.min("doc_id").alias("head")))
    parts = components(links(heads, distance))
    rooted = heads.join(parts.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    classes = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    return own.join(classes.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(rooted: DataFrame) -> DataFrame:
    """(_row) of each root's smallest id; nulls come last, equal ids by row. From (_row, id, root)."""
    return rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row"))["_row"].alias("_row")).select("_row")


def one_of_each(docs: DataFrame, distance: int = 3, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they are: the one with the smallest id. Rows of different components stay, whatever their ids."""
    named = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    own = stored(prints(named, words, seed, "_row", text_col).select(F.col("doc_id").alias("_row"), "fp"))
    parts = components(links(own.select("fp").distinct(), distance))
    ids = named.select("_row", F.col(id_col).cast("long").alias("id"))
    rooted = own.join(ids.hint("merge"), "_row").join(parts.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("_row", "id", F.coalesce("root", "fp").alias("root"))
    return named.join(first_of_each(rooted).hint("merge"), "_row", "left_semi").select(*docs.columns)
