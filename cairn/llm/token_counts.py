"""Token counts by rank-synchronous array merging.

A text is cut where no piece of the vocabulary can cross (before a run of word marks, at newlines). Each cut unit, the
"pre-token", is counted once for a worker and remembered. Unknown units of a batch are held as one ragged numpy array of
symbols; in every round each sequence applies its lowest-rank pair, all sequences at once, until none has a pair left;
the surviving symbols are counted, unknown characters as their UTF-8 bytes.

Nulls count as empty texts (0 tokens); repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

MARK = "▁"
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
NONE = np.iinfo(np.int64).max
#: Units remembered for each worker before the memory is dropped and begun anew.
REMEMBER = 300_000


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(buf):
        head = varint()
        kind = head & 7
        if kind == 0:
            yield head >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield head >> 3, buf[at : at + n]
            at += n


class PieceCounter:
    """Counts the tokens of a sentencepiece BPE model that normalises by identity."""

    def __init__(self, path: str):
        pieces, self.dummy_prefix, byte_fallback = [], True, False
        with open(path, "rb") as f:
            raw = f.read()
        for field, value in _fields(raw):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif k == 3:
                        kind = v
                pieces.append((piece, score, kind))
            elif field == 2:
                byte_fallback = any(k == 35 and v for k, v in _fields(value))
            elif field == 3:
                for k, v in _fields(value):
                    if k == 2 and v:
                        raise ValueError("only models that normalise by identity are supported")
                    if k == 3:
                        self.dummy_prefix = bool(v)
                    if k == 4 and v:
                        raise ValueError("models that remove extra white space are not supported")
        if not byte_fallback:
            raise ValueError("only models with byte fallback are supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        known = {p: s for p, s, kind in pieces if kind == NORMAL}
        long = [p for p in known if len(p) > 1]
        self.cuts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in long)
        symbols = {p: i for i, p in enumerate(dict.fromkeys([*known, *(c for p in long for c in p)]))}
        n = len(symbols)
        #: Characters that no piece holds: n + (UTF-8 bytes - 1).
        self.width = n + 4
        self.of_char = np.full(0x110000, n + 3, np.int64)
        self.of_char[:0x10000], self.of_char[:0x800], self.of_char[:0x80] = n + 2, n + 1, n
        self.cost = np.array([1 if p in known else len(p.encode()) for p in symbols] + [1, 2, 3, 4], np.int64)
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        ranks = {s: i for i, s in enumerate(sorted(set(known.values()), reverse=True))}
        merges = {}
        for p in long:
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    merges[a * self.width + b] = (ranks[known[p]], symbols[p])
        keys = np.array(sorted(merges), np.int64)
        self.keys, self.ranks, self.made = keys, np.array([merges[k][0] for k in keys.tolist()], np.int64), np.array([merges[k][1] for k in keys.tolist()], np.int64)
        self._index(keys)
        self.pattern = re.compile(self._cuts(long) if self.cuts else r"(?s:.+)")
        self.seen: dict[str, int] = {}

    @staticmethod
    def _cuts(long: list[str]) -> str:
        """A pattern of units between which no piece reaches: also between word characters and others, but for the few characters that some piece joins across."""
        odd: set[str] = set()
        inside = lambda c: (c.isalnum() or c == "_") and c not in odd
        while True:
            found = {c for p in long for a, b in zip(p, p[1:]) if MARK not in (a, b) and inside(a) != inside(b) for c in (a if inside(a) else b)}
            if not found:
                break
            odd |= found
            if len(odd) > 100:
                return f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
        out = "".join(map(re.escape, sorted(odd)))
        word = f"[^\\W{out}]"
        other = f"(?:[^\\w{MARK}\n]+|[{out}])" if out else f"[^\\w{MARK}\n]"
        return f"{MARK}*{word}+|{MARK}*{other}+|{MARK}+|\n"

    def _index(self, keys: np.ndarray) -> None:
        """Hash levels over the merge keys: a key that finds its slot taken goes on to the next level, and the slot says so."""
        self.levels, left = [], np.arange(len(keys))
        bits, odd = 20, 0x9E3779B97F4A7C15
        while len(left):
            slot = (keys[left].astype(np.uint64) * np.uint64(odd) >> np.uint64(64 - bits)).astype(np.int64)
            table, more = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            more[slot[rest]] = True
            self.levels.append((np.uint64(odd), np.uint64(64 - bits), table, more))
            left, bits, odd = left[rest], 14, (odd * 0xD1342543DE82EF95 | 1) & (1 << 64) - 1

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no merge) and merged symbol of each pair."""
        want = left * self.width + right
        rank, made, open_ = np.full(len(want), NONE), np.zeros(len(want), np.int64), None
        for odd, shift, table, more in self.levels:
            part = want if open_ is None else want[open_]
            slot = (part.astype(np.uint64) * odd >> shift).astype(np.int64)
            at = table[slot]
            hit = self.keys[at] == part
            hit &= at >= 0
            to = np.flatnonzero(hit) if open_ is None else open_[hit]
            rank[to], made[to] = self.ranks[at[hit]], self.made[at[hit]]
            rest = np.flatnonzero(~hit & more[slot])
            open_ = rest if open_ is None else open_[rest]
            if not len(open_):
                break
        return rank, made

    def merge(self, units: list[str]) -> np.ndarray:
        """Surviving tokens of each unit."""
        out = np.zeros(len(units), np.int64)
        sym = self.of_char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        seq = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = self._pairs(sym[:-1], sym[1:])
        rank[:-1][seq[1:] != seq[:-1]] = NONE
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            low = np.minimum.reduceat(rank, first)
            if (low == NONE).any():
                ended = np.repeat(low == NONE, size)
                out += np.bincount(seq[ended], self.cost[sym[ended]], len(out)).astype(np.int64) if ended.any() else 0
                live = ~ended
                sym, seq, rank, made = sym[live], seq[live], rank[live], made[live]
                size, low = size[low != NONE], low[low != NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            s = seq[hit]
            several = np.r_[False, s[1:] == s[:-1]]
            if several.any():
                # Overlapping hits: of each run of neighbours every second one, from its left end.
                run = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | ~several[1:]])
                hit = hit[((np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) & 1) == 0]
                m, s = made[hit], seq[hit]
                several = np.r_[False, s[1:] == s[:-1]]
                # A merge may make a pair that ranks as low: such sequences apply their leftmost pair alone.
                before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(sym) - 1)
                joined = np.r_[False, (hit[1:] == hit[:-1] + 2) & several[1:]]
                bar = rank[hit]
                left = self._pairs(np.where(joined, np.r_[0, m[:-1]], sym[before]), m)[0] <= bar
                left |= self._pairs(sym[before], m)[0] <= bar
                right = self._pairs(m, sym[after])[0] <= bar
                bad = left & (hit > 0) & (seq[before] == s) | right & (hit + 2 < len(sym)) & (seq[after] == s)
                if bad.any():
                    hit = hit[~(several & np.isin(s, s[bad]))]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))
            sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
            # Only pairs that a merge touched are looked up anew.
            touched = np.zeros(len(sym), bool)
            touched[hit] = True
            touched[hit[hit > 0] - 1] = True
            new = np.flatnonzero(touched)
            rank[new] = NONE
            new = new[new + 1 < len(sym)]
            new = new[seq[new] == seq[new + 1]]
            rank[new], made[new] = self._pairs(sym[new], sym[new + 1])
        return out

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", MARK)
        return self.pattern.findall(MARK + text if self.dummy_prefix else text)

    def count(self, batch: list[str]) -> list[int]:
        cut = [self.units(t) for t in batch]
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        new = list(set().union(*cut).difference(self.seen))
        if new:
            self.seen.update(zip(new, self.merge(new).tolist()))
        get = self.seen.__getitem__
        return [sum(map(get, u)) for u in cut]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text. No shuffle; the vocabulary is read by each worker from model_path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for b in slices(batches):
            batch = b.column("text").to_pylist()
            n = count(batch)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in batch], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
