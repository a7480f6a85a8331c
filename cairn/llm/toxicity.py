"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values.

Learning. Labelled documents (a bounded sample of them, `sample` of each class) give counts of words and of word beginnings by
class. Their log-odds are taken with an informative Dirichlet prior (the pooled counts, scaled to `prior` pseudo-counts);
those whose z-score reaches `least_z`, in either direction, keep their log-odds, at most `features` of each, and all other
words share one negative score, so that the expected score of clean text is negative.

Scoring. The scores of all words of a whole text are summed along it. Between two new minima of that sum the maximal-scoring
segments (Ruzzo and Tompa) are independent of the rest, and none scores higher than the sum rises there: a linear scan by
arrays finds the highest segment and the stretches that can hold a significant one, and the segments are built in those alone.
For random clean text the best segment follows an extreme-value law: a segment of score s among n words is expected
K n exp(-lambda s) times, with lambda from the clean score distribution and K from the clean sample's maxima. The evidence of
significant segments is summed, and a logistic curve fitted to the learning rows turns it into a probability.

Words are what stands between ASCII characters that are no letters, lower-cased. Null and empty texts have no segment and score
as the curve says for none (low). Rows that repeat each give a row; labels that repeat a doc_id count once (the higher); other
columns are ignored. Where labels lack a class, or none of them has a document, the curve stays flat and low: every score is 0
to twenty digits (1 / (1 + e^50)), and nothing is rejected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_batches, texts

#: ASCII characters that are no letters, to spaces.
PARTS = bytes(b if b > 127 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: Lengths of word beginnings that count as tokens beside whole words.
STEMS = (4, 5, 6)
#: Labelled documents of each class that the model is fitted on at most; features of each direction kept at most.
SAMPLE = 8000
FEATURES = 20_000
REMEMBER = 300_000
#: Pseudo-count of every token beside its share of the pooled prior; occurrences in one document that count.
FLAT = 0.5
OFTEN = 3
#: Log-odds are kept between these.
MOST, LEAST = 8.0, -2.0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(PARTS).split()


def tokens(word: bytes) -> list[str]:
    said = word.decode("utf-8", "ignore")
    return [said, *("^" + said[:k] for k in STEMS if len(said) >= k)]


class Weights(dict):
    """Word to score, worked out when a word is first met."""

    def __init__(self, weights: dict[str, float], other: float):
        self.weights, self.other = weights, other

    def __missing__(self, word: bytes) -> float:
        known = [x for t in tokens(word) if (x := self.weights.get(t)) is not None]
        most = max(known, default=self.other)
        self[word] = out = most if most > 0 else min([self.other, *known])
        return out


#: The words that this worker remembers, of one model at a time.
_seen: Weights | None = None


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    other: float = -0.2
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Of each word: the highest log-odds of the word and its beginnings if one is positive, else the lowest, or `other` where none is known."""
        global _seen
        if _seen is None or _seen.weights is not self.weights or _seen.other != self.other or len(_seen) > REMEMBER:
            _seen = Weights(self.weights, self.other)
        return np.fromiter(map(_seen.__getitem__, words), float, len(words))

    def bar(self, n: int) -> float:
        return math.log(self.size * max(n, 1))

    def segments(self, score: np.ndarray, above: float = 0.0) -> tuple[float, list[tuple[float, int, int]]]:
        """The highest score of a segment (0 where none is positive), and all maximal-scoring segments (score, first word, end) that score more than `above`."""
        total = np.concatenate(([0.0], np.cumsum(score)))
        rise = total - np.minimum.accumulate(total)
        best = float(rise.max())
        if best <= above or best <= 0:
            return best, []
        out: list[tuple[float, int, int]] = []
        # A stretch begins where the sum stands at its minimum so far.
        begin = np.flatnonzero(rise == 0)
        high = np.maximum.reduceat(rise, begin)
        stop = np.append(begin[1:], len(total))
        for a, b in zip(begin[high > above].tolist(), stop[high > above].tolist()):
            stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
            for i in (np.flatnonzero(score[a : b - 1] > 0) + a).tolist():
                now = (total[i], total[i + 1], i, i + 1)
                while True:
                    at = len(stack) - 1
                    while at >= 0 and stack[at][0] >= now[0]:
                        at -= 1
                    if at < 0 or stack[at][1] >= now[1]:
                        stack.append(now)
                        break
                    now = (stack[at][0], now[1], stack[at][2], now[3])
                    del stack[at:]
            out += [(float(right - left), x, y) for left, right, x, y in stack if right - left > above]
        return best, out

    def evidence(self, score: np.ndarray) -> tuple[float, float, int]:
        """(of the best segment, summed over those expected less than once, how many are expected fewer than 0.05 times): lambda s - ln(K n) of each, minus the logarithm of how many clean text would have."""
        bar = self.bar(len(score))
        best, segs = self.segments(score, max(bar / self.rate, 0.0))
        each = [x for s, _, _ in segs if (x := self.rate * s - bar) > 0]
        first = min(max(self.rate * best - bar, -5.0), 60.0) if best > 0 else -5.0
        return first, math.log1p(sum(each)), sum(x > 3 for x in each)

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(min(a + b * best + c * total, 500.0), -500.0)))

    def passages(self, text: str, most: float = 0.05) -> list[tuple[int, int, float]]:
        """(first word, end, expected number) of the segments expected fewer than `most` times in clean text of this length."""
        score = self.scores(words_of(text))
        bar = self.bar(len(score))
        expected = ((a, b, math.exp(bar - self.rate * s)) for s, a, b in self.segments(score)[1])
        return [x for x in expected if x[2] < most]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    reg = ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + reg + 1e-9 * np.eye(len(w)), x.T @ (y - p) - reg @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(model: Model, clean: list[tuple[float, int]], freq: dict[float, int]) -> None:
    """lambda: the clean distribution's mean of exp(lambda score) is 1; K: the mean of lambda max - ln n over clean texts, less Euler's constant."""
    scores, weight = np.array([*freq]), np.array([*freq.values()], float)
    weight /= weight.sum()
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (weight * np.exp(np.minimum(mid * scores, 600))).sum() < 1 else (low, mid)
    model.rate = low
    maxima = [low * s - math.log(n) for s, n in clean if s > 0 and n > 0]
    model.size = math.exp(min(max(np.mean(maxima) - 0.5772, -12.0), 3.0)) if maxima else 1.0


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None, each: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `each` labelled rows of either class, by hash of doc_id; the ids, 2 x each at most, are broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    if learn is not None:
        known = known.where(learn)
    few = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for c in (0, 1)]
    return texts(docs, id_col, text_col).join(F.broadcast(few[0].unionByName(few[1])), "doc_id")


def learn_weights(rows: DataFrame, prior: float, least_z: float, features: int) -> dict[str, float]:
    """Log-odds with Dirichlet priors of at most `features` tokens of either sign, highest z-score first. Counts are summed by Spark; only what is kept goes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                own: Counter = Counter()
                words = words_of(text)
                for w, k in Counter(words).items():
                    for t in tokens(w):
                        own[t] += k
                by[label].update({t: min(k, OFTEN) for t, k in own.items()})
                by[label][""] += len(words)  # the words of the class
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][t] for t in names], pa.int64()), pa.array([by[0][t] for t in names], pa.int64())], names=["token", "y", "x"])

    summed = stored(rows.select("text", "label").mapInArrow(count, "token string, y long, x long").groupBy("token").agg(F.sum("y").alias("y"), F.sum("x").alias("x")))
    total = summed.where("token = ''").first()
    if total is None or not total["y"] or not total["x"]:
        return {}
    n1, n0 = float(total["y"]), float(total["x"])
    a = F.lit(FLAT) + prior * (F.col("x") + F.col("y")) / (n1 + n0)
    odds = F.log((F.col("y") + a) / (n1 + prior - F.col("y"))) - F.log((F.col("x") + a) / (n0 + prior - F.col("x")))
    z = odds / F.sqrt(1 / (F.col("y") + a) + 1 / (F.col("x") + a))
    known = summed.where("token <> ''").select("token", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= least_z)
    kept = [known.where(F.col("z") * sign > 0).orderBy(F.desc(F.abs("z")), "token").limit(features).collect() for sign in (1, -1)]
    return {r["token"]: round(min(max(r["odds"], LEAST), MOST), 3) for r in kept[0] + kept[1]}


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", each: int = SAMPLE, prior: float = 500.0, least_z: float = 3.0, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most `each` labelled documents of either class (all of them where there are fewer). The driver gets a few numbers of each, and the frequency of each distinct score."""
    spark = docs.sparkSession
    rows = stored(sample(docs, labels, label, learn, each, id_col, text_col)).select("text", "label")
    model = Model(learn_weights(rows, prior, least_z, features))
    if not model.weights:
        return model

    def measured(run, schema: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(model)

        def each_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield run(shared.value, b.column("label"), [shared.value.scores(words_of(t)) for t in b.column("text").to_pylist()])

        return rows.mapInArrow(each_, schema)

    def first(own: Model, label_: pa.Array, scored: list[np.ndarray]) -> pa.RecordBatch:
        clean = [s for s, y in zip(scored, label_.to_pylist()) if not y]
        value, n = np.unique(np.concatenate(clean), return_counts=True) if clean else (np.zeros(0), np.zeros(0, int))
        freq = pa.StructArray.from_arrays([pa.array(value), pa.array(n)], names=["score", "n"])
        # The first row of a batch bears its frequencies.
        held = pa.ListArray.from_arrays(pa.array([0, *[len(freq)] * len(scored)], pa.int32()), freq)
        return pa.RecordBatch.from_arrays([label_, pa.array([len(s) for s in scored], pa.int64()), pa.array([own.segments(s, math.inf)[0] for s in scored], pa.float64()), held], names=["label", "n", "best", "freq"])

    def second(own: Model, label_: pa.Array, scored: list[np.ndarray]) -> pa.RecordBatch:
        shape = [own.evidence(s) for s in scored]
        return pa.RecordBatch.from_arrays([label_, *(pa.array([x[i] for x in shape], pa.float64()) for i in (0, 1))], names=["label", "best", "total"])

    found = stored(measured(first, "label int, n long, best double, freq array<struct<score: double, n: long>>"))
    clean = [(r["best"], r["n"]) for r in found.where("label = 0").select("best", "n").collect()]  # at most `each` rows
    freq = {r["score"]: r["n"] for r in found.select(F.explode("freq").alias("x")).groupBy("x.score").agg(F.sum("x.n").alias("n")).collect()}  # as many as there are distinct weights
    calibrate(model, clean, freq)
    shape = measured(second, "label int, best double, total double").collect()  # three numbers of at most 2 x each documents
    model.curve = tuple(logistic(np.array([(r["best"], r["total"]) for r in shape]), np.array([r["label"] for r in shape], float)).tolist())
    return model


def score(docs: DataFrame, model: Model, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_passages) of every whole text; n_passages: segments expected fewer than 0.05 times in clean text. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            out, passages = [], []
            for text in b.column("text").to_pylist():
                best, total, n = own.evidence(own.scores(words_of(text)))
                out.append(own.probability(best, total)), passages.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64()), pa.array([int(s >= least) for s in out], pa.int32()), pa.array(passages, pa.int64())], names=["doc_id", "score", "predicted", "n_passages"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int, n_passages long")


def reject(docs: DataFrame, model: Model, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose whole text scores below `least`. No shuffle."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            keep = [own.probability(*own.evidence(own.scores(words_of(text)))[:2]) < least for text in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
