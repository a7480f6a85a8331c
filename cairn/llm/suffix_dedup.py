"""Exact substring dedup over sampled suffixes, range-partitioned by their leading bytes.

Every byte covered by a string of `length` bytes that also starts elsewhere goes. Suffixes are sampled by content: of the
`length - lead + 1` starts inside any window of `length` bytes, the one whose `lead`-byte string has the least hash is an
anchor, so equal windows share an anchor at the same place, and a suffix array over anchors is enough (about 2 in
`length - lead + 2` positions). Each anchor has a context: what lies so near that a window around the anchor can reach it.

1. Anchors with a leading string met once go no further. Where all contexts of a leading string are equal, all of it is repeated.
2. For the others one context of each kind is fetched. Sampled splitters (range partitioning) deal these suffixes into
   buckets by leading bytes; a splitter never parts equal leading strings, so no comparison crosses a boundary. A bucket
   sorts its suffixes, and the reversed texts to their left, by multikey quicksort in blocks of eight bytes; common-prefix
   lengths of neighbours give, for every offset of a window around the anchor, which windows are equal.
   A leading string with more than `crowd` contexts would fill one task: its contexts are dealt over all tasks, their windows
   named by hash, offset by offset, and counted by Spark. The result is the same either way (tests hold both to all windows).
3. Extents go back to all anchors with that context, and as intervals to their documents.

A leading string and its context are each named by a 64-bit XXH3 of their bytes, and only two that agree in both are taken as
equal unread; windows in a bucket are compared by bytes. The running hash that picks anchors decides nothing else.
Nulls count as empty texts. Repeated rows are each other's copies. Other columns are ignored, whatever their names; columns to
keep may have any name but uid, th, cover and said.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions, slices, stored, text_batches

LENGTH = 400
LEAD = 160
#: Contexts of one leading string that a bucket may hold.
CROWD = 20_000
#: Letters that stand for a word; words are parted by ASCII white space, as bytes.split() does.
CODE = 8
_WORD = re.compile(rb"[^ \t\n\r\x0b\f]+")
#: Bytes hashed at once; a power of two.
BUFFER = 1 << 20

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of all substrings of a buffer from one running sum (arithmetic modulo 2**64)."""

    up = down = np.zeros(0, np.uint64)

    def __init__(self, buf: np.ndarray):
        if len(Hashes.up) <= len(buf):
            n = max(BUFFER + 8192, len(buf) + 1)
            Hashes.up, Hashes.down = _powers(_BASE, n), _powers(_INVERSE, n)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_VALUE[buf] * Hashes.up[: len(buf)], out=self.sums[1:])

    def of(self, first: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        x = (self.sums[end] - self.sums[first]) * Hashes.down[first]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by running minima from both ends of blocks of w."""
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[: len(x)] = x
    blocks = pad.reshape(-1, w)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(after, np.minimum.accumulate(blocks, axis=1).ravel()[w - 1 : w - 1 + n])


def anchors(bodies: list[bytes], length: int, lead: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, key, context, left, right) of all anchors of texts: key and context are XXH3 of the leading string and of the context, which has `left` bytes before the place and `right` from it on."""
    reach = length - lead
    step = BUFFER - 2 * length - 2 * reach
    digest = xxhash.xxh3_64_intdigest

    def pieces() -> Iterator[tuple[int, int, int, int, int]]:
        """(text, first byte, end, first window, end of windows)."""
        for t, body in enumerate(bodies):
            windows = len(body) - length + 1
            for i in range(0, windows, step):
                j = min(i + step, windows)
                yield t, max(i - reach, 0), min(j + reach + length, len(body)), i, j

    def solve(part: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, ...]:
        buf = np.frombuffer(b"".join(bodies[t][a:b] for t, a, b, _, _ in part), np.uint8)
        hashes = Hashes(buf)
        n = len(buf) - lead + 1
        key = hashes.of(slice(0, n), slice(lead, lead + n))
        place = np.uint64(BUFFER - 1)
        least = sliding_minimum(key & ~place | np.arange(n, dtype=np.uint64), reach + 1)
        real = np.zeros(len(least), bool)
        begin = np.cumsum([0] + [b - a for _, a, b, _, _ in part])
        for (_, a, _, i, j), at in zip(part, begin.tolist()):
            real[at + i - a : at + j - a] = True
        flag = np.zeros(n, bool)
        flag[(least[real] & place).astype(np.int64)] = True
        pos = np.flatnonzero(flag)
        own = np.searchsorted(begin, pos, "right") - 1
        text, first = (np.array([p[k] for p in part])[own] for k in (0, 1))
        inside = pos - begin[own]
        left = np.minimum(first + inside, reach)
        right = np.minimum(np.array([len(bodies[p[0]]) for p in part])[own] - first - inside, length)
        at = first + inside
        rows = list(zip([bodies[t] for t in text.tolist()], at.tolist(), left.tolist(), right.tolist()))
        key = np.array([digest(body[i : i + lead]) for body, i, _, _ in rows], np.uint64)
        context = np.array([digest(body[i - x : i + y], x) for body, i, x, y in rows], np.uint64)
        return text, at, key, context, left, right

    part, size = [], 0
    for p in pieces():
        if part and size + p[2] - p[1] > BUFFER:
            yield solve(part)
            part, size = [], 0
        part.append(p)
        size += p[2] - p[1]
    if part:
        yield solve(part)


def multikey_sort(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): order of byte rows within groups, and the bytes that each shares with the one before (-1 at a group's first).

    Multikey quicksort, eight bytes a step: rows are parted by one word, and only those still tied are looked at in the next.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    common = np.full(n, width, np.int64)
    edge = np.r_[True, group[order][1:] != group[order][:-1]] if n else np.zeros(0, bool)
    common[edge] = -1
    for depth in range(words.shape[1]):
        tied = np.flatnonzero(~edge | np.r_[~edge[1:], False])
        if not len(tied):
            break
        run = np.cumsum(edge)[tied]
        word = words[order[tied], depth]
        by = np.lexsort((word, run))
        order[tied], word = order[tied][by], word[by]
        new = np.flatnonzero((run[1:] == run[:-1]) & (word[1:] != word[:-1])) + 1
        apart = (word[new] ^ word[new - 1]).astype(">u8").view(np.uint8).reshape(-1, 8)
        common[tied[new]] = depth * 8 + (apart != 0).argmax(axis=1)
        edge[tied[new]] = True
    return order, common


def extents(bodies: list[bytes], left: np.ndarray, right: np.ndarray, group: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (distinct within a group) how far to the left and right windows reach that another context of the group also has; 0, 0 where none."""
    reach, n = length - lead, len(bodies)
    after = np.zeros((n, length), np.uint8)
    before = np.zeros((n, reach), np.uint8)
    for i, (body, at) in enumerate(zip(bodies, left.tolist())):
        x = np.frombuffer(body, np.uint8)
        after[i, : len(x) - at] = x[at:]
        before[i, :at] = x[:at][::-1]
    most, least = np.full(n, -1), np.full(n, reach + 1)
    ranked = [multikey_sort(rows, group) for rows in (after, before)]
    for o in range(reach + 1):
        ids = []
        for (order, common), need in zip(ranked, (length - o, o)):
            block = np.zeros(n, np.int64)
            block[order] = np.cumsum(common < need)
            ids.append(block)
        fit = np.flatnonzero((left >= o) & (right >= length - o))
        pair = ids[0][fit] * (n + 1) + ids[1][fit]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        hit = fit[by[np.r_[False, same] | np.r_[same, False]]] if len(fit) else fit
        most[hit] = o
        least[hit] = np.minimum(least[hit], o)
    found = most >= 0
    return np.where(found, most, 0), np.where(found, length - least, 0)


def spans(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that intervals cover."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, crowd: int = CROWD, read: Callable[[str], bytes] = str.encode) -> DataFrame:
    """(uid, th, cover array<struct<a, b>>) of docs(uid, th, text): what each text, as `read` gives its bytes, repeats, as overlapping byte intervals."""
    spark = docs.sparkSession
    reach = length - lead
    signed = lambda x: pa.array(x.view(np.int64))
    wide = "uid long, th long, place long, key long, context long, left int, right int"

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for text, place, key, context, left, right in anchors([read(t) for t in b.column("text").to_pylist()], length, lead):
                of = np.unique(np.stack([text, place]), axis=1, return_index=True)[1]  # segments of a long text share anchors
                at = pa.array(text[of])
                yield pa.RecordBatch.from_arrays([b.column("uid").take(at), b.column("th").take(at), pa.array(place[of]), signed(key[of]), signed(context[of]), pa.array(left[of].astype(np.int32)), pa.array(right[of].astype(np.int32))], names=["uid", "th", "place", "key", "context", "left", "right"])

    found = stored(docs.mapInArrow(sample, wide))
    # Stored, so that the join below deals both sides anew and can split a leading string that very many texts share.
    keys = stored(found.groupBy("key").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1"))
    members = stored(found.join(keys, "key").withColumn("plain", F.col("low") == F.col("high")).drop("n", "low", "high"))
    forget(found, keys)
    several = members.where("not plain")
    kinds = several.groupBy("key", "context").agg(F.count("*").alias("m"), F.min(F.struct("uid", "th", "place", "left", "right")).alias("at"))
    want = kinds.groupBy("at.uid", "at.th").agg(F.collect_list(F.struct("at.place", "at.left", "at.right", "key", "context", "m")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for text, want_ in zip(b.column("text").to_pylist(), b.column("want").to_pylist()):
                body = read(text)
                for w in want_:
                    for col, x in zip(out, (w["key"], w["context"], w["m"], w["left"], body[w["place"] : w["place"] + 24], body[w["place"] - w["left"] : w["place"] + w["right"]])):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["key", "context", "m", "left", "head", "body"])

    contexts = stored(docs.join(want, ["uid", "th"]).select("text", "want").mapInArrow(fetch, "key long, context long, m long, left int, head binary, body binary"))
    # Stored: the planner sees how few there are before it joins, and a join that deals both sides anew can split a hot key.
    crowds = stored(contexts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            key, context, m, left = (rows.column(c).to_numpy() for c in ("key", "context", "m", "left"))
            body = rows.column("body").to_pylist()
            own = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])]) if len(key) else np.zeros(0, np.int64)
            key, context, m, left, body = key[own], context[own], m[own], left[own].astype(np.int64), [body[i] for i in own]
            right = np.array([len(x) for x in body], np.int64) - left
            a, b = extents(body, left, right, key, length, lead)
            a, b = np.where(m > 1, left, a), np.where(m > 1, right, b)
            keep = b > 0
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, context, a, b)], names=["key", "context", "a", "b"])

        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < 8192:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            # The last leading string may go on.
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if cut:
                yield done(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            size = rows.num_rows - cut
        if size:
            yield done(pa.Table.from_batches(held))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for key, context, left, body in zip(*(b.column(c).to_pylist() for c in ("key", "context", "left", "body"))):
                o = np.arange(max(0, left + length - len(body)), left + 1)
                named = np.array([digest(body[i : i + length]) for i in (left - o).tolist()], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), key)), pa.array(np.full(len(o), context)), pa.array(o), signed(named)], names=["key", "context", "o", "window"])

    few = contexts.join(crowds, "key", "left_anti").repartitionByRange(partitions(spark), "head", "key").sortWithinPartitions("head", "key", "context")
    near = few.select("key", "context", "m", "left", "body").mapInArrow(solve, "key long, context long, a long, b long")
    many = contexts.join(crowds, "key", "left_semi").repartition("key", "context")
    each = many.where("m = 1").select("key", "context", "left", "body").unionByName(many.where("m > 1").select("key", "context", "left", "body")).mapInArrow(windows, "key long, context long, o long, window long")
    twice = each.groupBy("key", "o", "window").agg(F.min("context").alias("low"), F.max("context").alias("high")).where("low <> high").select("key", "o", "window")
    crowded = each.join(twice, ["key", "o", "window"]).groupBy("key", "context").agg(F.max("o").alias("a"), (F.lit(length) - F.min("o")).alias("b"))
    whole = many.where("m > 1").select("key", "context", F.col("left").cast("long").alias("a"), (F.octet_length("body") - F.col("left")).cast("long").alias("b"))
    # Stored for the same reason as the keys: very many anchors may share one context.
    reached = stored(near.unionByName(crowded).unionByName(whole).groupBy("key", "context").agg(F.max("a").alias("a"), F.max("b").alias("b")))
    span = lambda a, b: F.struct((F.col("place") - F.col(a)).cast("long").alias("a"), (F.col("place") + F.col(b)).cast("long").alias("b")).alias("span")
    cover = members.where("plain").select("uid", "th", span("left", "right")).unionByName(several.join(reached, ["key", "context"]).select("uid", "th", span("a", "b")))
    out = stored(cover.groupBy("uid", "th").agg(F.collect_set("span").alias("cover")))
    forget(members, contexts, crowds, reached)
    return out


def coded(text: str) -> bytes:
    """A text with each word as CODE letters of its hash: words, not bytes, are what windows then count."""
    digest = xxhash.xxh3_64_digest
    return base64.b64encode(b"".join([digest(w)[:6] for w in text.encode().split()]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), keep_text: bool = False, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, columns of keep]) of every row.

    words: what `words` successive words cover that also stand elsewhere, however short and whatever white space parts them, goes too.
    kept_text: the remaining bytes as text; of a character that is removed in part, the rest goes too.
    """
    text_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c) for c in keep if c not in (id_col, text_col)))
    named = named.withColumn("uid", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text")).withColumn("th", F.xxhash64("text", F.lit("text")))
    cover = repeated(named.where(F.octet_length("text") >= length).select("uid", "th", "text"), length, lead, crowd)
    rest = [c for c in named.columns if c not in ("doc_id", "text", "uid", "th")]
    base = named.join(cover, ["uid", "th"], "left")
    if words:
        # The leading string is two fifths of a window, as LEAD is of LENGTH, in whole words.
        long_enough = named.where(F.octet_length("text") >= 2 * words - 1).select("uid", "th", "text")
        said = repeated(long_enough, CODE * words, CODE * max(1, 2 * words // 5), crowd, coded)
        base = base.join(said.withColumnRenamed("cover", "said"), ["uid", "th"], "left")
    base = base.select("doc_id", "text", "cover", *["said"] * bool(words), *rest)
    kinds = {f.name: f for f in base.schema.fields}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text + "".join(f", `{c}` {kinds[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            said = b.column("said").to_pylist() if words else [None] * b.num_rows
            for text, cover_, said_ in zip(b.column("text").to_pylist(), b.column("cover").to_pylist(), said):
                body = text.encode()
                found = [(x["a"], x["b"]) for x in cover_ or ()]
                if said_:
                    at = [m.span() for m in _WORD.finditer(body)]
                    found += [(at[-(-x["a"] // CODE)][0], at[x["b"] // CODE - 1][1]) for x in said_]
                gone = spans(found)
                kept, at = [], 0
                for x, y in gone:
                    kept.append(body[at:x])
                    at = y
                kept = b"".join([*kept, body[at:]])
                for col, x in zip(out, (len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None)):
                    col.append(x)
            cols = [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out[: 5 if keep_text else 4], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 6 if keep_text else 5]
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(c) for c in rest)], names=[*names, *rest])

    return base.mapInArrow(run, schema)
