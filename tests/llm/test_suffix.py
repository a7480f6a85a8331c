"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import queries
from cairn.llm import suffix_dedup as S


def brute(bodies, length):
    seen = Counter(x[i : i + length] for x in bodies for i in range(len(x) - length + 1))
    out = []
    for x in bodies:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((len(x), int(gone[:-1].sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda n, al="abcdefgh é": "".join(rng.choice(al) for _ in range(n))
    shared = [word(rng.randrange(20, 120)) for _ in range(6)]
    out = ["".join(rng.choice([word(rng.randrange(0, 50)), rng.choice(shared), rng.choice(shared)[rng.randrange(20) :]]) for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    return out + ["a" * 200, "ab" * 70, "a" * 41, "a" * 40, "", word(39), shared[0] * 3, word(3000, "ab"), out[3], out[3]]


@pytest.mark.parametrize("crowd", [S.CROWD, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_small_windows(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(S, "BUFFER", 1 << 10)
    body = texts(seed)
    rows = list(enumerate(body)) + [(3, body[3]), (None, body[5]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.remove_repeats(docs.withColumn("key", F.lit(1)).withColumn("n_bytes", F.lit("x")), length=40, lead=16, crowd=crowd, keep_text=True).collect()
    want = brute([(t or "").encode() for _, t in rows], 40)
    order = lambda x: (x[0] is None, x)
    assert sorted((tuple(r)[:5] for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r["text"] or "").encode() for r in rows], 400)
    got = queries.queries()["op9_suffix_dedup"](spark, folder).collect()
    assert sorted(tuple(r) for r in got) == sorted((r["doc_id"], *w) for r, w in zip(rows, want))
    assert sum(r["n_removed"] for r in got) > 0


def test_odd_rows(spark, corpus):
    body, folder = corpus
    want = brute([(t or "").encode() for _, t in body], 400)
    got = queries.queries()["op9_suffix_dedup"](spark, folder).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *w) for (i, _), w in zip(body, want))
    assert queries.queries()["op9_suffix_dedup"](spark, f"{folder}/none").collect() == []


def test_multikey_sort():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (300, 21)).astype(np.uint8)
    rows[:, :9] = 0
    group = rng.integers(0, 4, 300)
    order, common = S.multikey_sort(rows, group)
    plain = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert plain == sorted(plain)
    for k in range(1, 300):
        (g, x), (h, y) = plain[k - 1], plain[k]
        assert common[k] == (-1 if g != h else next((i for i in range(21) if x[i] != y[i]), 21))


def test_segments_share_anchors(monkeypatch):
    """Every window holds an anchor, equal windows hold it at the same place, however long texts are cut for hashing."""
    rng = random.Random(9)
    part = bytes(rng.randrange(97, 101) for _ in range(900))
    body = bytes(rng.randrange(97, 101) for _ in range(2500)) + part + bytes(rng.randrange(97, 101) for _ in range(3100)) + part
    bodies = [body, part + b"zz", b"", b"a" * 700]

    def found():
        out = {}
        for text, place, key, context, left, right in S.anchors(bodies, 40, 16):
            out |= {(t, p): (k, c, a, b) for t, p, k, c, a, b in zip(text.tolist(), place.tolist(), key.tolist(), context.tolist(), left.tolist(), right.tolist())}
        return out

    whole = found()
    monkeypatch.setattr(S, "BUFFER", 1 << 10)
    cut = found()
    for have in (whole, cut):
        at = [sorted(p for t, p in have if t == i) for i in range(len(bodies))]
        for i, b in enumerate(bodies):
            for w in range(len(b) - 40 + 1):
                assert any(w <= p <= w + 24 for p in at[i])
        inside = lambda t, base: {p - base for p in at[t] if base + 24 <= p <= base + 900 - 40}
        assert inside(0, 2500) == inside(0, 2500 + 900 + 3100) == inside(1, 0) and inside(1, 0)
    assert {k: v for k, v in whole.items() if k in cut} == {k: v for k, v in cut.items() if k in whole}
