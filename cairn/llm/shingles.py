"""Near copies by SimHash and word shingles: texts of which at least four fifths of all five-word shingles of either are shared (Jaccard), exactly.

1. SimHash fingerprints over the shingles meet at the anchors of a covering code (simhash.links), and what links there within
   three bits is compared by whole sets. That joins most copies, and large groups of them, at little cost.
2. A fingerprint of 64 bits cannot be covered much further: texts that share four fifths of their shingles differ in 10 bits on
   average, and anchors for 12 bits would need over 2,000 replicas of each fingerprint. What step 1 cannot see is found by
   prefixes. If shingles stand in any order common to all texts, two such texts share one among the first n - ceil(4n/5) + 1
   of their n shingles. The order puts shingles that many texts have last (counts within batches; they change the speed, never
   the result). Texts that meet at a shingle and are not joined yet are compared: neighbours first, then, of each shingle's
   texts, those outside its largest component with all others. Sizes and a parity sketch (its differing bits are no more than
   the differing shingles) rule out most pairs before whole sets are compared.
3. In a sketch of a large text all places are even odds, so that every two that share a passage would pass. Their shingles are
   dealt into parts by hash: two near copies are near copies in one part at least (if more than a ninth differed in each, more
   would in all), so that prefixes, sizes and sketches are those of parts, which are as small as other texts.

Shingles are 64-bit hashes of five lower-cased (A-Z) words; a shorter text is one shingle. Texts with the same words are one text
(64-bit hash), and those without words are copies of each other; nulls count as empty. Rows that repeat count as copies.
Columns of any name may stand beside those used, but for names that begin with _cairn_.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import components, forget, slices, stored, text_batches
from .simhash import LOWER, first_of_each, links, majority

WORDS = 5
#: Texts link at a similarity of P / Q.
P, Q = 4, 5
#: Bits in which fingerprints may differ at an anchor.
BITS = 3
#: Common shingles that the order knows; more or fewer change the speed alone.
COMMON = 200_000
#: Words of 64 bits in a sketch.
SKETCH = 8
MARKS = [f"x{i}" for i in range(SKETCH)]
PIECE = f"part: int, size: int, {', '.join(f'{m}: long' for m in MARKS)}"
#: Texts of more shingles than this have a second sketch, of so many words: in the first, nearly all places of theirs are even odds.
LARGE, SECOND = 1024, 128
#: Texts of up to 5/4 of this many shingles are one part; level l, of up to 4 ** l times as many, has 4 ** l parts. Levels overlap by 5/4, so that any two that may link share one.
PART = 512
LEVELS = 8
#: Shingles of a text that a row tells before its own; more or fewer change how often a pair is met, never which.
BEFORE = 8
#: Texts of one shingle that stand in one line when neighbours are compared; lines of a larger group are joined by their first texts.
LINE = 4096


def shingles(text: str | None, words: int = WORDS) -> tuple[int, bytes]:
    """A signed hash of the text's words, and the hashes of its shingles, repeats included, eight bytes each."""
    cut = (text or "").encode().translate(LOWER).split()
    joined = b" ".join(cut)
    node = xxhash.xxh64_intdigest(joined, 1) - (1 << 63)
    if not cut:
        return node, b""
    ends = list(accumulate([len(w) + 1 for w in cut]))
    digest = xxhash.xxh64_digest
    return node, b"".join([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[words - 1 :] or ends[-1:])])


def distinct(raw: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(raw, ">i8").astype(np.int64))


def sketch(found: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Of each of 64 times `words` places the parity of the shingles that fall there."""
    bits = np.bincount(found & 64 * words - 1, minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def levels(n: int) -> list[int]:
    """The levels at which a text of n shingles has parts, one or two; the last one has no end."""
    return [k for k in range(LEVELS) if (not k or n > PART * 4 ** (k - 1)) and (k == LEVELS - 1 or Q * PART * 4**k >= P * n)]


def part_of(found: np.ndarray, level: int) -> np.ndarray:
    return found >> 32 & 4**level - 1


def prefix(found: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each part the shingles, rarest first, among which that of every text that is near enough shares one; a shingle's last three bits are the level."""
    out = [found[:0]]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    met = np.where(common[at] == found, count[at], 0) if len(common) else np.zeros(len(found), np.int64)
    for level in levels(len(found)):
        part = part_of(found, level)
        order = np.lexsort((found, met, part))
        size = np.bincount(part, minlength=4**level)
        rank = np.arange(len(found)) - np.repeat(np.cumsum(size) - size, size)
        out.append(found[order][rank < np.repeat(size - (P * size + Q - 1) // Q + 1, size)] & ~7 | level)
    return np.concatenate(out)


def parts(found: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(part, size, sketch) of the parts of a text that has several; a part's number is level | place << 3."""
    out = []
    for level in filter(None, levels(len(found))):
        part = part_of(found, level)
        size = np.bincount(part, minlength=4**level)
        bits = np.bincount(part * 64 * SKETCH + (found & 64 * SKETCH - 1), minlength=4**level * 64 * SKETCH).astype(np.uint8) & 1
        out += [(level | i << 3, size[i], x) for i, x in enumerate(np.packbits(bits).view(np.int64).reshape(-1, SKETCH)) if size[i]]
    return out


def named(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows with _cairn_row, _cairn_node (hash of the words), _cairn_fp (fingerprint), _cairn_size (distinct shingles), the sketch in _cairn_x0 .., those of large texts in _cairn_large and, by part, in _cairn_parts and, on a batch's first row, _cairn_hot: its shingles that repeat."""
    at = docs.columns.index(text_col)
    more = f"_cairn_node long, _cairn_fp long, _cairn_size int, {', '.join(f'_cairn_{m} long' for m in MARKS)}, _cairn_large array<long>, _cairn_parts array<struct<{PIECE}>>, _cairn_hot array<struct<h: long, n: int>>"
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingles(t) for t in b.column(at).cast(pa.string()).to_pylist()]
            sets = [distinct(raw) for _, raw in found]
            drawn = np.stack([sketch(x) for x in sets])
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            hot = pa.StructArray.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1].astype(np.int32))], names=["h", "n"])
            ends = pa.array([0, *[len(hot)] * len(found)], pa.int32())
            several = [parts(x) for x in sets]
            flat = [p for some in several for p in some]
            marks = np.stack([x for _, _, x in flat]) if flat else np.zeros((0, SKETCH), np.int64)
            cut = pa.StructArray.from_arrays([pa.array([p for p, _, _ in flat], pa.int32()), pa.array([n for _, n, _ in flat], pa.int32()), *(pa.array(c) for c in marks.T.copy())], names=["part", "size", *MARKS])
            cuts = pa.array(np.r_[0, np.cumsum([len(some) for some in several])].astype(np.int32))
            prints = np.frombuffer(b"".join(majority(raw) for _, raw in found), ">i8").astype(np.int64)
            made = [pa.array([k for k, _ in found], pa.int64()), pa.array(prints), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(c) for c in drawn.T.copy()), pa.array([sketch(x, SECOND) if len(x) > LARGE else None for x in sets], pa.list_(pa.int64())), pa.ListArray.from_arrays(cuts, cut), pa.ListArray.from_arrays(ends, hot)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.names)

    return docs.mapInArrow(run, schema).withColumn("_cairn_row", F.monotonically_increasing_id())


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ascending; counts) of the COMMON most common at most."""
    best = rows.select(F.explode("_cairn_hot").alias("x")).groupBy("x.h").agg(F.sum("x.n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    table = np.array(sorted((r["h"], r["n"]) for r in best), np.int64).reshape(-1, 2)
    return table[:, 0].copy(), table[:, 1].copy()


def meetings(texts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, node, line) of texts(node, text): prefix shingles that different texts have; line: a part of the key's texts, LINE of them or so."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [prefix(distinct(shingles(t)[1]), *shared.value) for t in b.column("text").to_pylist()]
            node = np.repeat(b.column("node").to_numpy(), [len(k) for k in keys])
            key = np.concatenate(keys)
            for i in range(0, len(key), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 65536]), pa.array(node[i : i + 65536])], names=["key", "node"])

    starts = stored(texts.select("node", "text").mapInArrow(spread, "key long, node long"))
    # Keys are counted before the join, and stored, so that a key of very many texts is dealt to several tasks.
    twice = stored(starts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = stored(starts.join(twice.select("key").hint("merge"), "key").distinct())
    forget(starts, twice)
    # Of shingles that the very same texts have (a count and 128 bits of hashes of theirs agree) one is enough: any two that meet at one meet at all.
    same = (F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(x))).alias(x) for x in "gh"))
    several = stored(met.groupBy("key").agg(*same).where("n > 1").groupBy("n", "g", "h").agg(F.min("key").alias("key")))
    out = stored(met.join(several.hint("merge"), "key").select("key", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / LINE)).alias("line")))
    forget(met, several)
    return out


def whole_sets(texts: DataFrame) -> DataFrame:
    """(node, found) of texts(node, text): all shingles, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [distinct(shingles(t)[1]) for t in b.column("text").to_pylist()]
            ends = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["node", "found"])

    return texts.select("node", "text").mapInArrow(run, "node long, found array<long>")


def may_link(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether sizes and sketches leave it open that two texts are near copies."""
    total = a["size"] + b["size"]
    apart = sum((F.bit_count(a[m].bitwiseXOR(b[m])) for m in MARKS), F.lit(0))
    return (Q * F.least(a["size"], b["size"]) >= P * F.greatest(a["size"], b["size"])) & ((P + Q) * apart <= (Q - P) * total)


def proven(pairs: DataFrame, drawn: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies: sketches first, then whole sets, which are made of the texts that are left alone."""
    side = lambda x: drawn.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("size", *MARKS)))
    of = lambda x: {c: F.col(f"{x}_{c}") for c in ("size", *MARKS)}
    left = stored(pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(may_link(of("a"), of("b"))).select("a", "b", (F.col("a_size") + F.col("b_size")).alias("total")))
    large = lambda x: drawn.where("large is not null").select(F.col("node").alias(x), F.col("large").alias(f"l{x}"))
    apart = F.aggregate(F.zip_with("la", "lb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    left = stored(left.join(large("a"), "a", "left").join(large("b"), "b", "left").where(F.coalesce((P + Q) * apart <= (Q - P) * F.col("total"), F.lit(True))).select("a", "b"))
    # Stored, so that the planner knows its size before it chooses the join with the texts.
    nodes = stored(left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = stored(whole_sets(texts.join(nodes, "node")).dropDuplicates(["node"]))
    a, b = (sets.select(F.col("node").alias(x), F.col("found").alias(f"f{x}")) for x in "ab")
    both = F.size(F.array_intersect("fa", "fb"))
    out = stored(left.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where((P + Q) * both >= P * (F.size("fa") + F.size("fb"))).select("a", "b"))
    forget(left, nodes, sets)
    return out


def neighbours(rows: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): rows(fp, node) that follow each other in the order of fingerprints."""
    order = Window.partitionBy(*by).orderBy("fp", "node")
    return rows.select(F.col("node").alias("a"), F.lead("node").over(order).alias("b")).where("b is not null")


def linked(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """Edges (a, b) between nodes of texts(node, fp, size, x0.., large, parts, text), one row a node or several, that span every component of near copies."""
    met = meetings(texts, common)
    nodes = stored(met.select("node").distinct())
    drawn = stored(texts.join(nodes, "node").select("node", "fp", "size", "large", "parts", *MARKS).distinct())
    own = drawn.where(Q * PART >= P * F.col("size")).select("node", F.lit(0).alias("part"), "size", *MARKS)
    pieces = stored(own.unionByName(drawn.select("node", F.explode("parts").alias("p")).select("node", "p.*")))
    # 1. Fingerprints at the anchors of the covering code.
    heads = stored(drawn.groupBy("fp").agg(F.min("node").alias("head")))
    at = lambda x: heads.select(F.col("fp").alias(f"f{x}"), F.col("head").alias(x))
    near = links(heads, bits).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(at("a"), "fa").join(at("b"), "fb").select("a", "b")
    same = drawn.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    # 2. Neighbours among the texts of a shingle, in its lines and from line to line.
    lines = met.join(drawn.select("node", "fp"), "node")
    firsts = lines.groupBy("key", "line").agg(F.min(F.struct("fp", "node")).alias("s")).select("key", "s.fp", "s.node")
    first = proven(near.unionByName(same).unionByName(neighbours(lines, ["key", "line"])).unionByName(neighbours(firsts, ["key"])), drawn, texts)
    # 3. What is still apart: each shingle's texts outside its largest component with all others.
    side = stored(met.drop("line").join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node")))
    sizes = stored(side.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main"))
    part = F.expr("cast(key & 7 | (shiftrightunsigned(key, 32) & (shiftleft(1L, cast(2 * (key & 7) as int)) - 1)) * 8 as int)")
    marked = stored(side.join(sizes, "key").withColumn("part", part).join(pieces, ["node", "part"]))
    # Two that share several shingles of a part meet at the least; where both tell a shared one before, they have met.
    line = Window.partitionBy("node", "part").orderBy("key").rowsBetween(-BEFORE, -1)
    told = stored(marked.withColumn("before", F.collect_list("key").over(line)))
    a, b = told.where("root <> main").alias("a"), told.alias("b")
    of = lambda x: {c: F.col(f"{x}.{c}") for c in ("size", *MARKS)}
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & once & may_link(of("a"), of("b")) & ~F.arrays_overlap("a.before", "b.before"))
    last = proven(cross.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), drawn, texts)
    forget(met, nodes, heads, side, sizes, marked, told, pieces, drawn)
    return first.unionByName(last)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near copies the row with the smallest id (nulls last), all columns as they are. Rows of different components stay, whatever their ids."""
    text_batches(docs.sparkSession)
    rows = stored(named(docs, text_col))
    texts = rows.select(*(F.col(f"_cairn_{c}").alias(c) for c in ("node", "fp", "size", "large", "parts", *MARKS)), F.col(text_col).cast("string").alias("text"))
    parts = stored(components(linked(texts, common_shingles(rows))))
    ids = rows.select("_cairn_row", "_cairn_node", F.col(id_col).cast("long").alias("id")).join(parts.withColumnRenamed("node", "_cairn_node"), "_cairn_node", "left")
    # Stored, so that the planner knows its size before it chooses the join with the texts.
    chosen = stored(first_of_each(ids.select(F.col("_cairn_row").alias("_row"), "id", F.coalesce("root", "_cairn_node").alias("root"))).withColumnRenamed("_row", "_cairn_row"))
    return rows.join(chosen, "_cairn_row", "left_semi").select(*docs.columns)
