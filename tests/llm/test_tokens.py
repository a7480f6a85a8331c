"""Token counts, byte-level BPE and packing against their libraries."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from cairn.llm import queries
from cairn.llm.byte_bpe import ByteBPE
from cairn.llm.packing import best_fit, complete_bins


def rows(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def test_counts_equal_the_library(spark, corpus):
    import sentencepiece

    body, folder = corpus
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = sorted((i, len((t or "").encode()), len(n), len(n) > 4096) for i, t in body for n in [lib.encode(t or "")])
    assert sorted(tuple(r) for r in rows(spark, folder, "op8_token_counts")) == want


def test_bytes_equal_the_library(spark, corpus):
    import tiktoken

    body, folder = corpus
    codec = ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((i, len(n), sha(" ".join(map(str, n)).encode()), sha((t or "").encode())) for i, t in body for n in [lib.encode_ordinary(t or "")])
    assert sorted(tuple(r)[:4] for r in rows(spark, folder, "op10_byte_bpe")) == want


def test_stream_never_breaks_characters():
    codec = ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "日本語 😀é plain ꙮ"
    ids = codec.encode(text).tolist()
    parts = list(codec.stream(ids))
    assert "".join(parts) == text and "�" not in text and all("�" not in p for p in parts)
    broken = codec.ranks[b"\xe6"]
    assert "".join(codec.stream([broken, codec.ranks[b"a"]])) == "�a"
    assert codec.complete(codec.encode(text)) == 0 and codec.complete(codec.encode(text)[:1]) != 0


def test_packing_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    body, folder = corpus
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    total = 0
    for i, t in body:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    got = rows(spark, folder, "op7_best_fit_packing")
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by.values():
        placed.sort()
        assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:])) and sum(placed[-1]) <= 2048
    assert len(by) <= math.ceil(total / 2048) + 1


@pytest.mark.parametrize("counts", [{}, {5: 3}, {6: 2, 5: 2, 4: 2, 3: 2, 2: 1}, {7: 1, 6: 1, 5: 1, 4: 1, 3: 2}, {10: 4}, {1: 100, 9: 7}])
def test_bins_are_as_few_as_can_be(counts):
    def least(items, bins):
        if not items:
            return len(bins)
        best = 99
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + items[0] <= 10:
                best = min(best, least(items[1:], (*bins[:i], bins[i] + items[0], *bins[i + 1 :])))
        return min(best, least(items[1:], (*bins, items[0])))

    runs = complete_bins(counts, 10)
    held = Counter()
    for filling, times in runs:
        assert sum(filling) <= 10
        for n in filling:
            held[n] += times
    assert held == Counter(counts)
    items = sorted(Counter(counts).elements(), reverse=True)
    if len(items) < 12:
        assert sum(t for _, t in runs) == least(items, ())
    assert sum(t for _, t in runs) <= sum(t for _, t in best_fit(counts, 10))


@pytest.mark.parametrize("name", ["op7_best_fit_packing", "op8_token_counts", "op10_byte_bpe"])
def test_empty_tables(spark, corpus, name):
    assert rows(spark, f"{corpus[1]}/none", name) == []


def test_words_met_again_are_remembered(monkeypatch):
    """Words of every batch are encoded once, however many others come and go, and ids are those of the library all the same."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from cairn.llm import packing

    monkeypatch.setattr(packing, "REMEMBER", 40)
    path = public_tokenizers.path("word_bpe_49k.json")
    words, plain, encoded = packing.WordIds(path), Tokenizer.from_file(path), []
    real = words._encode
    monkeypatch.setattr(words, "_encode", lambda parts: encoded.extend(parts) or real(parts))
    always = "steady Words stay, straße İx ΑΣ ét́ ﬁn 梦12 <|endoftext|>'s"
    for i in range(12):
        batch = [f"{always} new{chr(97 + i)}{j} other{chr(97 + j)}{i}, ÄÖ{i}" for j in range(9)] + ["", " \n"]
        want = [plain.encode(t, add_special_tokens=False).ids for t in batch]
        assert [list(memoryview(x).cast("I")) for x in words.ids(batch)] == want
    assert encoded.count("steady") == encoded.count("straße") == 1
