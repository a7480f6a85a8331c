"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are surface forms: the shape of every word (letters and digits by class, runs collapsed, punctuation as it stands),
hashed to `TERMS` places, and a few terms for structure (a word that repeats the one before, repeated lines, very short text).
A bounded sample of labelled documents (`each` of either class) gives term weights, a truncated SVD of the weighted
term matrix, and unit vectors with labels; these, of a size fixed by the parameters, are broadcast. Every document, whole,
is projected and compared with all labelled vectors in exact blocked cosine products; the `k` nearest vote with their
similarity as weight.

Null texts count as empty. A text with no weighted term, empty texts among them, has no neighbour and scores the share of good labels.
Rows that repeat each give a row; labels that repeat a doc_id count once (the lower); other columns are ignored. Without labels every score is 1/2.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts

TERMS = 1024
_REPEAT, _LINES, _SHORT = TERMS - 3, TERMS - 2, TERMS - 1
#: Labelled documents of each class, latent dimensions, neighbours that vote.
SAMPLE = 3000
DIMENSIONS = 48
NEIGHBOURS = 25
REMEMBER = 500_000
_RUN = re.compile(r"([aA0])\1+|(.)\2{2,}")


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs of those collapsed; other characters as they are, three or more alike as three."""
    classed = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(lambda m: m[1] or m[2] * 3, classed)


class Terms:
    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def counts(self, text: str) -> np.ndarray:
        """Occurrences of each term in a text, as shares of its words; structure terms as shares too."""
        words = text.encode().split()
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        for w in set(words).difference(self.seen):
            self.seen[w] = zlib.crc32(shape(w.decode()).encode()) % (TERMS - 3)
        out = np.bincount(np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words)), minlength=TERMS).astype(float)
        out[_REPEAT] = sum(map(eq, words, words[1:]))
        lines = [x for x in text.split("\n") if x.strip()]
        out[_LINES] = (len(lines) - len(set(lines))) * len(words) / max(len(lines), 1)
        out /= max(len(words), 1)
        out[_SHORT] = len(words) < 5
        return out


TERMS_OF = Terms()


@dataclass
class Model:
    weight: np.ndarray  # of each term
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents, unit length
    labels: np.ndarray
    share: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts) * self.weight @ self.basis
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 1e-9)

    def vote(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Score of each row: the similarity-weighted share of good labels among its k nearest labelled vectors."""
        if not len(self.vectors):
            return np.full(len(counts), self.share)
        near = self.project(counts) @ self.vectors.T
        k = min(k, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sim = np.maximum(np.take_along_axis(near, at, 1), 0.0) ** 2
        total = sim.sum(axis=1)
        # One pseudo-neighbour of little weight holds the share of good labels.
        return ((sim * self.labels[at]).sum(axis=1) + 0.05 * self.share) / (total + 0.05)


def build(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    if not len(labels):
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), labels, 0.5)
    seen = (counts > 0).sum(axis=0)
    weight = np.log((1 + len(labels)) / (1 + seen)) + 0.05
    rows = np.sqrt(counts) * weight
    value, vector = np.linalg.eigh(rows.T @ rows)
    basis = vector[:, np.argsort(-value)[:dimensions]]
    model = Model(weight, basis, np.zeros((0, 1)), labels.astype(float), float(labels.mean()))
    model.vectors = model.project(counts)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", each: int = SAMPLE, dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most `each` labelled documents of either class, by hash of doc_id; the driver holds 2 x each x TERMS numbers at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    if learn is not None:
        known = known.where(learn)
    few = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for c in (0, 1)]
    rows = texts(docs, id_col, text_col).join(F.broadcast(few[0].unionByName(few[1])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, value = [], []
            for text in b.column("text").to_pylist():
                c = TERMS_OF.counts(text)
                at.append(np.flatnonzero(c).tolist())
                value.append(c[at[-1]].tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64()))], names=["doc_id", "label", "at", "value"])

    found = sorted(stored(rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, at array<int>, value array<double>")).collect())
    counts = np.zeros((len(found), TERMS))
    for i, r in enumerate(found):
        counts[i, r["at"]] = r["value"]
    return build(counts, np.array([r["label"] for r in found], float), dimensions)


def score(docs: DataFrame, model: Model, least: float = 0.3, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            body = b.column("text").to_pylist()
            s = shared.value.vote(np.stack([TERMS_OF.counts(t) for t in body]), k) if body else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
