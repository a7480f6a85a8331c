"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding by an incremental UTF-8 machine.

Encoding. The merges are compiled into a relation on tokens: (a, b) may stand side by side when the merges of their joined
bytes give exactly a, b. Every prefix of a piece then has one last token, and that depends on the last tokens of a few
earlier prefixes only. A transducer state holds the prefixes from which some token may still reach beyond the present byte,
with the tokens not yet written on the way to each; what all of them share is written at once (the lookahead is bounded
by the longest token). States and transitions are made when first met, as in the subset construction, and remembered.

Decoding. Tokens give bytes; a state machine over UTF-8 lead and continuation bytes runs from token to token and tells
where complete characters end, so that a stream never shows half a character.

Nulls count as empty texts; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts

#: Pieces, and transitions, remembered for each worker before the memory is dropped and begun anew.
REMEMBER = 750_000
TRANSITIONS = 1_000_000
#: The rank of what is never merged.
NEVER = 1 << 40


def merged(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The merges applied one by one, lowest rank first and leftmost among equals. For compiling and tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: Tokens that their own merges make; others can come only as a whole piece.
        self.starts = {t[:k] for t in ranks for k in range(1, len(t))}
        self._own: dict[bytes, bool] = {}
        self._fit: dict[tuple[bytes, bytes], bool] = {}
        self._spines: dict[tuple[bytes, int], tuple] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: (token written last or None, bytes since the oldest live prefix, the unwritten tokens of each prefix or None).
        self.states: list[tuple] = [(None, b"", ((),))]
        self.ids = {self.states[0]: 0}
        self.next: dict[int, tuple[int, tuple[bytes, ...]]] = {}

    def own(self, t: bytes) -> bool:
        if (known := self._own.get(t)) is None:
            known = self._own[t] = t in self.ranks and merged(self.ranks, t) == [t]
        return known

    def _spine(self, t: bytes, side: int) -> list[tuple[bytes, int]] | None:
        """The parts at one end of a token (0 left, 1 right) as its merges grow, each with the rank of the merge that takes it up; None where those ranks do not rise."""
        known = self._spines.get((t, side))
        if known is None:
            parts, out = [t[i : i + 1] for i in range(len(t))], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if at == (len(parts) - 2 if side else 0):
                    out.append((parts[-1 if side else 0], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((t, NEVER))
            rising = all(a[1] < b[1] for a, b in zip(out, out[1:]))
            known = self._spines[t, side] = (out if rising else None,)
        return known[0]

    def fit(self, a: bytes | None, b: bytes) -> bool:
        """Do the merges of a + b leave a, b? No merge may join the parts that stand at the border while both are there."""
        if a is None:
            return True
        if (known := self._fit.get((a, b))) is None:
            if len(self._fit) > TRANSITIONS:
                self._fit.clear()
            left, right = self._spine(a, 1), self._spine(b, 0)
            if left is None or right is None:
                known = merged(self.ranks, a + b) == [a, b]
            else:
                i = j = 0
                known = True
                while known:
                    (x, gone), (y, over) = left[i], right[j]
                    rank = self.ranks.get(x + y, NEVER)
                    # Among equal ranks the leftmost merge goes first.
                    if rank < gone and rank <= over and rank != NEVER:
                        known = False
                    elif gone == over == NEVER:
                        break
                    elif gone <= over:
                        i += 1
                    else:
                        j += 1
            self._fit[a, b] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[bytes, ...]]:
        wrote, buf, rest = self.states[state]
        buf += bytes((byte,))
        found = None
        for j, own in enumerate(rest):
            if own is not None and self.own(t := buf[j:]) and self.fit(own[-1] if own else wrote, t):
                found = (*own, t)
                break
        if found is None:
            raise ValueError("the ranks are no merge table")
        live = [own if own is not None and buf[j:] in self.starts else None for j, own in enumerate(rest)] + [found]
        first = next(j for j, own in enumerate(live) if own is not None)
        live, buf = live[first:], buf[first:]
        some = [own for own in live if own is not None]
        n = 0
        while all(len(own) > n for own in some) and len({own[n] for own in some}) == 1:
            n += 1
        out = some[0][:n]
        rest = tuple(None if own is None else own[n:] for own in live)
        if n:
            wrote = out[-1]
        key = (wrote if any(own == () for own in rest) else None, buf, rest)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        return to, out

    def run(self, piece: bytes) -> list[bytes]:
        """Tokens of one piece."""
        if piece in self.ranks:
            return [piece]
        out: list[bytes] = []
        if len(self.next) > TRANSITIONS:
            self._reset()
        state, known = 0, self.next
        for byte in piece:
            key = state << 8 | byte
            got = known.get(key)
            if got is None:
                got = known[key] = self._step(state, byte)
            state, wrote = got
            if wrote:
                out += wrote
        return out + list(self.states[state][2][-1])


#: The well-formed UTF-8 byte sequences. From state 0 a lead byte goes to the state that names what must follow.
_LEADS = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
_FOLLOWS = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
BROKEN = 8


def utf8_step(state: int, byte: int) -> int:
    """State after a byte: 0 between characters, BROKEN once bytes are no UTF-8."""
    if state == 0:
        return next((to for low, high, to in _LEADS if low <= byte <= high), BROKEN)
    low, high, to = _FOLLOWS.get(state, (1, 0, 0))
    return to if low <= byte <= high else BROKEN


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern, self.fst = regex.compile(pattern), Transducer(self.ranks)
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.decimal = [str(i) for i in range(size)]
        #: Tokens that begin and end between characters: the machine stays in state 0 over them.
        self.whole = np.array([self._after(0, t) == 0 for t in self.tokens])
        self.raw: dict[str, bytes] = {}

    @staticmethod
    def _after(state: int, token: bytes) -> int:
        for byte in token:
            state = utf8_step(state, byte)
        return state

    def learn(self, cut: Iterable[list[str]]) -> None:
        """Ids of the pieces of some texts that are not known yet."""
        if len(self.raw) > REMEMBER:
            self.raw.clear()
        new: set[str] = set()
        for pieces in cut:
            new.update(filterfalse(self.raw.__contains__, pieces))
        for piece in new:
            self.raw[piece] = np.array([self.ranks[t] for t in self.fst.run(piece.encode())], "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        pieces = self.pattern.findall(text)
        self.learn([pieces])
        return np.frombuffer(b"".join(map(self.raw.__getitem__, pieces)), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def complete(self, ids: np.ndarray, state: int = 0) -> int:
        """The machine's state after ids: 0 when they end with a complete character. Only runs of tokens with partial characters are stepped through."""
        part = np.flatnonzero(~self.whole[ids])
        last = -1
        for i in part.tolist():
            if state and i != last + 1:
                return BROKEN
            state = self._after(state, self.tokens[ids[i]])
            if state == BROKEN:
                return BROKEN
            last = i
        return BROKEN if state and last != len(ids) - 1 else state

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids as they arrive: each part holds complete characters; bytes that are no UTF-8 become U+FFFD."""
        held, state = b"", 0
        for i in ids:
            for byte in self.tokens[i]:
                to = utf8_step(state, byte)
                if to == BROKEN and state:
                    yield held.decode("utf-8", "replace")
                    held, to = b"", utf8_step(0, byte)
                held, state = held + bytes((byte,)), to
                if state == 0:
                    yield held.decode()
                    held = b""
                elif state == BROKEN:
                    yield "�"
                    held, state = b"", 0
        if held:
            yield held.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, complete[, ids]) of every whole text; complete: the ids end with a complete character. No shuffle."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, complete boolean" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for b in slices(batches):
            cols: list[list] = [[], [], [], [], []]
            cut = [bpe.pattern.findall(t) for t in b.column("text").to_pylist()]
            bpe.learn(cut)
            for pieces in cut:
                ids = np.frombuffer(b"".join(map(bpe.raw.__getitem__, pieces)), "<u4")
                listed = ids.tolist()
                said = " ".join(map(bpe.decimal.__getitem__, listed)).encode()
                for col, x in zip(cols, (len(listed), hashlib.sha256(said).hexdigest(), hashlib.sha256(bpe.decode(listed)).hexdigest(), bpe.complete(ids) == 0, listed if keep_ids else None)):
                    col.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            made = [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "complete", "ids"]
            yield pa.RecordBatch.from_arrays(made[: 6 if keep_ids else 5], names=names[: 6 if keep_ids else 5])

    return texts(docs, id_col, text_col).mapInArrow(run, schema)

