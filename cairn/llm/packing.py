"""Best-fit packing of token sequences by bin completion.

Texts are tokenised once; documents longer than a sequence are cut, and (doc_id, piece, start, length, ids_crc32) rows are
stored. What has to be packed is then a histogram: how many pieces there are of each length, at most `size` numbers
whatever the corpus. The driver completes bins around the largest length left: it enumerates undominated fillings of the
room beside it, prunes those whose waste exceeds what a better solution may waste, and keeps best-fit decreasing as the
first incumbent. A filling is applied as often as its lengths last, so that the search is over lengths, not over pieces.
The plan (runs of equal sequences) goes back as rows; pieces of one length are numbered by (length, block) counts, so that
no length, however common, is gathered in one task, and meet their place in the plan by a join on length and block.

Nulls count as empty texts: one piece, the separator alone. Repeated rows are separate documents. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress, islice
from operator import neg

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, stored, texts

#: Words remembered for each worker, in two halves: when the newer is full the older is dropped, but for words met meanwhile.
REMEMBER = 400_000
#: Pieces that one block of a length holds on average where all have that length.
BLOCK = 50_000
#: Nodes that the search may visit before it returns the best plan met.
NODES = 20_000


#: Fixed value: the split of words that the supported tokenizer files make after lower-casing.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What lies beyond the Latin letters.
BEYOND = re.compile("[^\x00-\u024f]")


class WordIds:
    """Token ids of texts by a tokenizer file that normalises by NFC and lower case, splits by WORDS and drops white space.

    Each white-space separated word is looked up; new ones of a batch are split, and their new parts encoded by the library in
    one string, in which every part ends with the one token that bears the suffix of word ends.
    Words for which that could differ (special strings, characters that NFC or lower-casing treat by context) go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kinds = [x["type"] for x in said["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or said["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": WORDS}:
            raise ValueError("the tokenizer file does not normalise and split as expected")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in said["added_tokens"]) or "(?!)")
        suffix, vocab = said["model"]["end_of_word_suffix"], said["model"]["vocab"]
        self.ends = np.zeros(max([*vocab.values(), *(x["id"] for x in said["added_tokens"])]) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.tokenizer, self.split = Tokenizer.from_file(path), regex.compile(WORDS)
        self.seen, self.parts, self.seen_before, self.parts_before = {}, {}, {}, {}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for i in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, 2048 of them encoded as one string."""
        out: list[bytes] = []
        for i in range(0, len(parts), 2048):
            some = parts[i : i + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *stops], stops)]
            else:
                out += self._whole(some)
        return out

    def _odd(self, word: str) -> bool:
        return not (word.isascii() or unicodedata.is_normalized("NFC", word) and "\u03a3" not in word) or self.special.search(word) is not None

    def _learn(self, new: list[bytes]) -> None:
        """Remember the ids of words; all are checked, lower-cased and decoded as one string, and only what that finds odd is looked at word by word."""
        text, whole = b" ".join(new).decode(), []
        if self._odd(text):
            whole = [raw for raw in new if self._odd(raw.decode())]
            new = list(set(new).difference(whole))
            text = b" ".join(new).decode()
        text = text.lower()
        low = text.split(" ") if new else []
        # A word of Latin letters alone is one part; letters beyond are left to the split, whose tables may be newer.
        latin = text.isascii() or not BEYOND.search(text)
        one = [w.isalpha() and (latin or not BEYOND.search(w)) for w in low]
        several = {raw: self.split.findall(w) for raw, w, x in zip(new, low, one) if not x}
        parts = set(compress(low, one)).union(*several.values()).difference(self.parts)
        met = parts & self.parts_before.keys()
        self.parts.update(zip(met, map(self.parts_before.__getitem__, met)))
        parts = list(parts - met)
        self.parts.update(zip(parts, self._encode(parts)))
        get = self.parts.__getitem__
        self.seen.update(zip(compress(new, one), map(get, compress(low, one))))
        self.seen.update((raw, b"".join(map(get, x))) for raw, x in several.items())
        self.seen.update(zip(whole, self._whole([raw.decode() for raw in whole])))

    def ids(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [t.encode().split() for t in batch]
        if 2 * len(self.seen) > REMEMBER:
            self.seen, self.seen_before = {}, self.seen
        if 2 * len(self.parts) > REMEMBER:
            self.parts, self.parts_before = {}, self.parts
        flat = list(chain.from_iterable(cut))
        found = list(map(self.seen.get, flat))
        lacks = [i for i, x in enumerate(found) if x is None]
        new = set(map(flat.__getitem__, lacks))
        met = new & self.seen_before.keys()
        self.seen.update(zip(met, map(self.seen_before.__getitem__, met)))
        self._learn(list(new - met))
        for i in lacks:
            found[i] = self.seen[flat[i]]
        ends = list(accumulate(map(len, cut)))
        return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the separator, cut into pieces of at most `size`."""
    tail = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for b in slices(batches):
            of, piece, start, length, crc = [], [], [], [], []
            for row, raw in enumerate(words.ids(b.column("text").to_pylist())):
                raw += tail
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    of.append(row), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram, as (filling, times) runs: the first incumbent."""
    left, out = dict(counts), []
    for big in sorted(counts, reverse=True):
        while left.get(big):
            filling, room, use = [big], size - big, {big: 1}
            while True:
                fit = max((n for n, c in left.items() if n <= room and c > use.get(n, 0)), default=0)
                if not fit:
                    break
                filling.append(fit)
                use[fit] = use.get(fit, 0) + 1
                room -= fit
            times = min(left[n] // k for n, k in use.items())
            for n, k in use.items():
                left[n] -= k * times
                if not left[n]:
                    del left[n]
            out.append((tuple(filling), times))
    return out


def _short(have: np.ndarray, lengths: np.ndarray, room: int) -> Iterator[tuple[int, ...]]:
    """Fillings of one or two lengths that leave nothing, which arrays find at once: what fillings() tries first."""
    fits = np.zeros(room + 1, np.int64)
    fits[lengths] = lengths
    if fits[room]:
        yield (room,)
    b = room - lengths
    good = (b > 0) & (b <= lengths) & (fits[b] > 0)
    for n, m in zip(lengths[good].tolist(), b[good].tolist()):
        if n != m or have[n] > 1:
            yield n, m


def fillings(left: np.ndarray, big: int, size: int, allowed: int) -> Iterator[tuple[int, ...]]:
    """Every undominated filling around `big` of any number of parts, least waste first: no part more would fit, and none could be a length that is left and longer by no more than the waste.

    left: how many there are of each length; `allowed`: waste beyond which a filling cannot be part of a better solution.
    """
    room = size - big
    have = left[: room + 1].copy()
    if big <= room:
        have[big] -= 1
    lengths = np.flatnonzero(have > 0)[::-1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        if room <= allowed:
            yield ()
        return
    seen = set()
    for filling in _short(have, lengths, room):
        seen.add(filling)
        yield filling
    # Bit r of reach[i]: lengths[i:], as often as they are there, can fill r.
    order, many = lengths.tolist(), have.tolist()
    reach, full = [1], (1 << room + 1) - 1
    for n in reversed(order):
        bits, c, step = reach[-1], min(many[n], room // n), 1
        while c:
            step = min(step, c)
            bits |= bits << n * step & full
            c -= step
            step *= 2
        reach.append(bits)
    reach.reverse()

    # What is longer by no more than the waste must be used up where a part is taken: by gaps, or by the parts before it.
    gaps = np.r_[room + 1, lengths[:-1] - lengths[1:]]
    used: dict[int, int] = {}

    def longer(n: int, waste: int, j: int) -> bool:
        while j and order[j - 1] <= n + waste:
            j -= 1
            if many[order[j]] > used.get(order[j], 0):
                return True
        return False

    def exact(target: int, i: int, waste: int, free: list[int]) -> Iterator[tuple[int, ...]]:
        if not target:
            if not longer(0, waste, len(order)):
                yield ()
            return
        start = bisect_left(order, -target, i, key=neg)
        at = bisect_left(free, start)
        for j in chain([start] if i and start == i and (at == len(free) or free[at] != i) else [], islice(free, at, None)):
            if not reach[j] >> target & 1:
                return
            n = order[j]
            if longer(n, waste, j):
                continue
            for k in range(min(many[n], target // n), 0, -1):
                if reach[j + 1] >> target - k * n & 1:
                    used[n] = k
                    for rest in exact(target - k * n, j + 1, waste, free):
                        yield (n,) * k + rest
            used.pop(n, None)

    for waste in range(min(allowed, room) + 1):
        if reach[0] >> room - waste & 1:
            for filling in exact(room - waste, 0, waste, np.flatnonzero(gaps > waste).tolist()):
                if filling not in seen:
                    yield filling


def choices(left: np.ndarray, big: int, size: int, allowed: int) -> Iterator[tuple[tuple[int, ...], bool]]:
    """(filling, often): each filling as often as its lengths last; then each once, after which any other may follow."""
    for often in (True, False):
        for filling in fillings(left, big, size, allowed):
            yield filling, often


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Sequences that any packing needs: the largest, over a, of Martello and Toth's bound. What is longer than size - a takes a
    sequence with nothing of a or longer; what is longer than half of one takes its own; the rest of at least a fills the room left."""
    n = np.zeros(size + 2, np.int64)
    for length, c in counts.items():
        n[length] = c
    many, mass = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * np.arange(size + 2))]  # of lengths below the index
    half = size // 2
    best = 0
    for a in range(half + 1):
        big = many[size + 1] - many[size - a + 1]
        middle, middle_mass = many[size - a + 1] - many[half + 1], mass[size - a + 1] - mass[half + 1]
        small = mass[half + 1] - mass[a]
        best = max(best, big + middle + max(0, -(-(small - (middle * size - middle_mass)) // size)))
    return int(best)


def complete_bins(counts: dict[int, int], size: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Runs (filling, times) that hold every length of the histogram in as few sequences as the search finds.

    It stops when the number of sequences equals lower_bound(), and returns the incumbent after `nodes` steps.
    """
    counts = {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in counts.items())
    bound = lower_bound(counts, size)
    best = best_fit(counts, size)
    least = sum(t for _, t in best)
    spent = 0
    whole = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        whole[n] = c
    # A depth-first search; a frame: (lengths left, sequences so far, waste so far, runs taken as a linked list, choices not yet tried).
    stack: list[tuple[np.ndarray, int, int, tuple | None, Iterator | None]] = [(whole, 0, 0, None, None)]
    while stack and least > bound and spent < nodes:
        left, bins, waste, runs, todo = stack.pop()
        spent += 1
        there = np.flatnonzero(left)
        if not len(there):
            if bins < least:
                best, least = _listed(runs), bins
            continue
        allowed = (least - 1) * size - total - waste  # waste that a better solution may still add
        if allowed < 0:
            continue
        big = int(there[-1])
        if todo is None:
            todo = choices(left, big, size, allowed)
        filling, often = next(todo, (None, None))
        if filling is None:
            continue
        stack.append((left, bins, waste, runs, todo))
        use: dict[int, int] = {big: 1}
        for n in filling:
            use[n] = use.get(n, 0) + 1
        lost = size - big - sum(filling)
        if lost > allowed:
            continue
        times = min(int(left[n]) // k for n, k in use.items())
        if lost:
            times = min(times, max(1, allowed // lost))
        if not often:
            if times == 1:
                continue
            times = 1
        after = left.copy()
        for n, k in use.items():
            after[n] -= k * times
        stack.append((after, bins + times, waste + lost * times, (runs, ((big, *filling), times)), None))
    return best


def _listed(runs: tuple | None) -> list[tuple[tuple[int, ...], int]]:
    out = []
    while runs is not None:
        runs, run = runs
        out.append(run)
    return out[::-1]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, size, separator, id_col, text_col))
    # Pieces of one length are ranked in blocks of BLOCK or so, at least four for each task.
    blocks = max(4 * partitions(spark), -(-cut.count() // BLOCK))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    sizes = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places, base, used = [], 0, dict.fromkeys(counts, 0)
    for filling, times in complete_bins(counts, size):
        offset = 0
        for n in filling:
            # Ranks used[n] .. used[n] + times - 1 of this length fill the sequences base .. base + times - 1 at this offset.
            places.append((n, used[n], used[n] + times - 1, base, offset))
            used[n] += times
            offset += n
        base += times
    assert used == counts
    plan = spark.createDataFrame(places, "length long, low long, high long, base long, offset long")
    blocks = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    # Each (length, block) knows its ranks; those of the plan that they meet go along as one array, sorted.
    meets = blocks.join(plan, "length").where("low < before + n and high >= before").groupBy("length", "block").agg(F.first("before").alias("before"), F.sort_array(F.collect_list(F.struct("low", "base", "offset"))).alias("runs"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("k", F.row_number().over(order) - 1).join(meets, ["length", "block"]).withColumn("rank", F.col("before") + F.col("k"))
    run = F.element_at(F.filter("runs", lambda r: r["low"] <= F.col("rank")), -1)
    return ranked.withColumn("run", run).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.base") + F.col("rank") - F.col("run.low")).alias("sequence_id"), F.col("run.offset").alias("offset"))
