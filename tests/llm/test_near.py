"""Near copies by shingles against brute force."""

import random
from collections import Counter

from cairn.llm.common import table


def brute(texts):
    """The least row of each component under Jaccard >= 0.8 of five-word shingles."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = [(t or "").encode().decode().translate(lower).encode().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and (a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in range(len(texts))}


def rows(n=400):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", " \n", "one", "One", "a b c d e", "a b c d e f"]
    bases = [[rng.choice(words) for _ in range(rng.choice([8, 30, 90, 300]))] for _ in range(20)]
    while len(out) < n:
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_shingles(spark):
    from cairn.llm.shingles import one_of_each

    texts = rows()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in one_of_each(docs).collect()} == brute(texts)


def test_shingles_on_table(spark):
    import corpus_pipeline as C

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = C.near_duplicates(spark, docs, "/root/testdata/sf0.01")
    at = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(at[i][0] for i in brute([t for _, t in at]))


def test_large_texts_that_share_a_passage(spark, monkeypatch):
    """Large texts of one passage are no candidates, one candidate pair is made seldom more than once, and near copies at all levels of parts are found."""
    from cairn.llm import shingles as S

    rng = random.Random(8)
    words = [f"w{i}" for i in range(20000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage = some(60)
    texts = [some(rng.randrange(300, 1500)) + passage + some(rng.randrange(300, 1500)) for _ in range(40)]
    for n in (500, 600, 650, 800, 1900, 2100, 2600, 5200, 9000):
        base = some(n)
        for share in (0.01, 0.02, 0.022, 0.03):
            copy = [rng.choice(words) if rng.random() < share else w for w in base]
            texts.append(copy[: n - rng.randrange(n // 20)])
    texts = [" ".join(w) for w in texts]
    made, real = [], S.proven

    def proven(pairs, *rest):
        made.append((pairs.count(), pairs.distinct().count()))
        return real(pairs, *rest)

    monkeypatch.setattr(S, "proven", proven)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute(texts)
    assert {r["doc_id"] for r in S.one_of_each(docs).collect()} == want and 45 < len(want) < len(texts)
    rows, pairs = made[1]
    assert pairs <= 50 and rows <= 500


def test_no_join_of_links_is_sized_by_guess(spark):
    """What a Python pass replicates 31 times is not broadcast for the size of what went in."""
    from cairn.llm import simhash

    heads = spark.range(1000).selectExpr("xxhash64(id) as fp", "id as head")
    assert "Broadcast" not in simhash.links(heads)._jdf.queryExecution().executedPlan().toString()
