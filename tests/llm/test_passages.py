"""Repeated passages by words."""

import random
from collections import Counter


def test_words(spark):
    """Every run of 51 words that stands twice goes, whatever its bytes; runs of 50 stay."""
    import corpus_pipeline as C

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    some = lambda n: [word() for _ in range(n)]
    short, long, fifty = ["a" if i % 3 else word()[:2] for i in range(51)], some(63), some(50)
    rows = [some(30) + short + some(20), some(9) + short, some(12) + fifty + some(5), some(70) + fifty, some(4) + long, long + some(200), long[5:60] + some(3)]
    rows += [some(rng.randrange(1, 300)) for _ in range(30)]
    texts = [rng.choice([" ", "\n"]).join(r) for r in rows]
    seen = Counter(w for w in (tuple(r[i : i + 51]) for r in rows for i in range(len(r) - 50)))
    want = []
    for r in rows:
        gone = {j for i in range(len(r) - 50) if seen[tuple(r[i : i + 51])] > 1 for j in range(i, i + 51)}
        want.append([w for j, w in enumerate(r) if j not in gone])
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"].split() for r in C.repeated_passages(spark, docs, "").select("doc_id", "text").collect()}
    assert [got[i] for i in range(len(rows))] == want and sum(map(len, want)) < sum(map(len, rows))


def test_bytes_of_few_words(spark):
    """A string of 400 bytes that stands twice goes though it has far fewer than 51 words, none of them long; one of 399 bytes stays."""
    import corpus_pipeline as C

    rng = random.Random(12)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(19)) for _ in range(n))
    twice, less = some(20) + ".", some(20)[:399]
    assert len(twice) == 400 and len(less) == 399
    texts = [f"1 {some(30)} {twice}1 {some(9)}", f"2{twice}2", f"1{less}1 {some(4)}", f"2{less}2", some(60)]
    want = [texts[0].replace(twice, ""), "22", *texts[2:]]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in C.repeated_passages(spark, docs, "").select("doc_id", "text", "n_chars").collect()}
    assert [got[i] for i in range(len(texts))] == [(t, len(t)) for t in want]
