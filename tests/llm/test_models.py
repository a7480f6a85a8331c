"""Toxicity and quality: held-out accuracy, the segment search against brute force, defined results for odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from cairn.llm import queries
from cairn.llm.quality_knn import TERMS, build, shape
from cairn.llm.toxicity import Model

SF = "/root/testdata/sf0.01"


def rows(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def auc(score, y):
    score, y = np.array(score), np.array(y)
    a, b = score[y == 1][:, None], score[y == 0][None]
    return (a > b).mean() + 0.5 * (a == b).mean()


@pytest.mark.parametrize(("name", "label", "n", "held", "least", "bar"), [("op2_toxicity", "toxic", 3, 1, 0.7, 0.9), ("op3_quality_knn", "quality", 5, 0, 0.3, 0.95)])
def test_held_out(spark, name, label, n, held, least, bar):
    got = {r["doc_id"]: r for r in rows(spark, SF, name)}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % n == held) and r["predicted"] == (r["score"] >= least) and 0 <= r["score"] <= 1 for i, r in got.items())
    known = [(got[r["doc_id"]]["score"], r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert auc(*zip(*known)) > bar


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_quality_knn"])
def test_odd_rows(spark, corpus, name):
    body, folder = corpus
    got = rows(spark, folder, name)
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in body)
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[0] == by[1]  # null is as empty
    assert rows(spark, f"{folder}/none", name) == []


def brute(score):
    """Maximal-scoring segments by definition: the best one, then those of what is left on either side."""

    def inside(a, b):
        best = max(((sum(score[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        _, _, i, j = best
        return [*inside(a, i), (i, j), *inside(j, b)]

    return inside(0, len(score))


def test_segments_are_the_maximal_ones():
    """All maximal segments, and with a bar those above it; the best is the best of all."""
    rng = random.Random(5)
    model = Model({"aaa": 1.37, "bbb": 0.61, "eee": -1.1}, other=-0.53)
    for _ in range(200):
        words = [rng.choice([b"aaa", b"bbb", b"ccc", b"ddd", b"eee"]) for _ in range(rng.randrange(0, 22))]
        score = model.scores(words)
        assert score.tolist() == [{b"aaa": 1.37, b"bbb": 0.61, b"eee": -1.1}.get(w, -0.53) for w in words]
        best, found = model.segments(score)
        assert [(a, b) for s, a, b in found if s > 1e-12] == brute(score.tolist())
        assert all(math.isclose(s, sum(score[a:b]), abs_tol=1e-9) for s, a, b in found)
        assert math.isclose(best, max((s for s, _, _ in found), default=0.0), abs_tol=1e-9)
        assert model.segments(score, 1.5)[1] == [x for x in found if x[0] > 1.5]


def test_evidence_is_of_all_significant_segments():
    rng = random.Random(6)
    model = Model({"aaa": 1.37, "bbb": 0.61}, other=-0.53, rate=0.9, size=0.1)
    for n in (0, 1, 30, 300):
        score = model.scores([rng.choice([b"aaa", b"bbb", b"ccc", b"ddd"]) for _ in range(n)])
        best, found = model.segments(score)
        each = [model.rate * s - math.log(model.size * max(n, 1)) for s, _, _ in found]
        got = model.evidence(score)
        assert math.isclose(got[0], min(max(model.rate * best - math.log(model.size * max(n, 1)), -5.0), 60.0) if best > 0 else -5.0)
        assert math.isclose(got[1], math.log1p(sum(x for x in each if x > 0)), abs_tol=1e-9) and got[2] == sum(x > 3 for x in each)


@pytest.mark.parametrize("labels", [[(1, 1), (2, 1)], [(1, 0)], [(900, 0), (901, 1)], [(1, None), (None, 1)]])
@pytest.mark.parametrize("name", ["toxicity", "quality_knn"])
def test_labels_that_teach_nothing(spark, labels, name):
    """One class alone, ids without a document, nulls: a defined score for every row."""
    import importlib

    module = importlib.import_module(f"cairn.llm.{name}")
    docs = spark.createDataFrame([(1, "some words here"), (2, "other words there"), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, label int")
    got = [r["score"] for r in module.score(docs, module.fit(docs, known, label="label")).collect()]
    assert len(got) == 3 and len(set(got)) == 1 if name == "toxicity" else all(0 <= x <= 1 for x in got)
    if name == "toxicity":
        assert got[0] < 1e-20
        assert module.reject(docs, module.fit(docs, known, label="label")).count() == 3


def test_votes_equal_plain_cosines():
    rng = np.random.default_rng(1)
    counts = rng.random((40, TERMS)) * (rng.random((40, TERMS)) < 0.02)
    labels = (np.arange(40) % 3 > 0).astype(float)
    model = build(counts, labels, 8)
    v = model.project(counts)
    for i in range(5):
        sim = sorted(((float(v[i] @ v[j]), labels[j]) for j in range(40)), reverse=True)[:7]
        w = [max(s, 0) ** 2 for s, _ in sim]
        want = (sum(a * y for a, (_, y) in zip(w, sim)) + 0.05 * labels.mean()) / (sum(w) + 0.05)
        assert model.vote(counts[i : i + 1], 7)[0] == pytest.approx(want)


def test_shapes():
    assert [shape(w) for w in ("Hello,", "HELLO!!", "x%%%%%", "año-12", "|")] == ["Aa,", "A!!", "a%%%", "a-0", "|"]
