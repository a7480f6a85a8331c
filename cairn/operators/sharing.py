"""Pairs of rows that share a key: found by bitmaps of blocks of rows, so that a pair comes once and is never stored to be told apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.tables import text_batches

#: Rows of a block on either side, and how many of them a bitmap spans at a time.
BLOCK, SPAN = 8192, 1024


class _Side:
    """The distinct ids of a block, and (row of id, key) of its rows."""

    def __init__(self, rows: pa.StructArray):
        keys = rows.field("keys")
        sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
        self.ids, row = np.unique(rows.field("id").to_numpy(zero_copy_only=False), return_inverse=True)
        self.row, self.keys = np.repeat(row, sizes), keys.flatten()


def _bits(a: _Side, b: _Side) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(ids of a, first row of b, bits): spans of b's ids, and for each id of a with keys the packed bits of those that share one."""
    coded = a.keys.dictionary_encode()
    at = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    cell = np.unique(np.stack([a.row[at >= 0], at[at >= 0]]), axis=1)
    if not cell.shape[1]:
        return
    who, starts = np.unique(cell[0], return_index=True)
    theirs = pc.fill_null(pc.index_in(b.keys, value_set=coded.dictionary, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    row, key = b.row[theirs >= 0], theirs[theirs >= 0]
    by = np.argsort(row, kind="stable")
    row, key = row[by], key[by]
    for i in range(0, len(b.ids), SPAN):
        low, high = np.searchsorted(row, (i, i + SPAN))
        packed = np.zeros((len(coded.dictionary), SPAN // 8), np.uint8)
        for j in range(0, len(packed), 1 << 14):
            part = (key[low:high] >= j) & (key[low:high] < j + (1 << 14))
            full = np.zeros((min(1 << 14, len(packed) - j), SPAN), bool)
            full[key[low:high][part] - j, row[low:high][part] - i] = True
            packed[j : j + (1 << 14)] = np.packbits(full, axis=1)
        # A slice of a's ids at a time, as one that has very many keys may stand among them.
        for s in range(0, len(who), 512):
            ends = np.r_[starts, cell.shape[1]][s : s + 513]
            yield a.ids[who[s : s + 512]], i, np.bitwise_or.reduceat(packed[cell[1][ends[0] : ends[-1]]], ends[:-1] - ends[0], axis=0)


def _met(left: DataFrame, right: DataFrame, group: str, run, out: str) -> DataFrame:
    """Blocks of left(group, id, keys) and right(group, id, keys) of one group, side by side as structs a and b, through run."""

    def packed(rows: DataFrame, name: str) -> DataFrame:
        # A row a group.
        sized = F.broadcast(rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias(f"{name}s")))
        dealt = rows.join(sized, group).withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"{name}s")))
        return dealt.groupBy(group, f"{name}s", name).agg(F.collect_list(F.struct("id", "keys")).alias(f"{name}_rows"))

    a, b = packed(left.select(group, "id", "keys"), "a"), packed(right.select(group, "id", "keys"), "b")
    # The smaller rows are repeated, for each block of the others.
    spans = F.broadcast(right.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias("n")))  # a row a group
    each = a.join(spans, group).select(group, "a_rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    both = b.select(group, "b", "b_rows").hint("merge").join(each, [group, "b"])

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (_Side(batch.column(name).slice(i, 1).flatten()) for name in ("a_rows", "b_rows"))
                yield from run(batch.column("group__").slice(i, 1), a, b)

    text_batches(left.sparkSession)
    return both.select(F.col(group).alias("group__"), "a_rows", "b_rows").mapInArrow(sides, out)


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of ids of left(id, keys) and right(id, keys) that share a key: each pair once. Rows that repeat an id are one."""

    def run(_, a: _Side, b: _Side) -> Iterator[pa.RecordBatch]:
        for ids, i, bits in _bits(a, b):
            for s in range(0, len(ids), 64):
                row, col = np.nonzero(np.unpackbits(bits[s : s + 64], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[s + row]), pa.array(b.ids[i + col])], names=["a", "b"])

    whole = lambda d: d.select(F.lit(0).alias("g"), F.col("id").cast("long").alias("id"), "keys")
    return _met(whole(left), whole(right), "g", run, "a long, b long")


def count_pairs(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, pairs): how many pairs of different ids of left(group, id, keys) and right(group, id, keys) share a group and a key; groups without one are absent."""

    def run(g: pa.Array, a: _Side, b: _Side) -> Iterator[pa.RecordBatch]:
        n = 0
        for ids, i, bits in _bits(a, b):
            n += int(np.bitwise_count(bits).sum())
            at = np.searchsorted(b.ids, ids)
            same = (at >= i) & (at < min(i + SPAN, len(b.ids)))
            same[same] = b.ids[at[same]] == ids[same]
            spot = at[same] - i
            n -= int((bits[same, spot // 8] >> (7 - spot % 8) & 1).sum())
        if n:
            yield pa.RecordBatch.from_arrays([g, pa.array([n], pa.int64())], names=[group, "pairs"])

    kind = left.schema[group].dataType.simpleString()
    met = _met(left, right, group, run, f"`{group}` {kind}, pairs long")
    return met.groupBy(group).agg(F.sum("pairs").alias("pairs"))
