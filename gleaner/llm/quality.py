"""Quality by ordinal cumulative-link regression on graded ratings.

A text's features are its distinct words and punctuation runs, hashed to ``BUCKETS``, and a few shape features (share of
capitals, of distinct words, word length) in bins. One weight vector is shared by all grades; ordered thresholds cut the
score s into grades: P(grade <= k) = sigmoid(threshold_k - s). A text gets its expected grade and the tail probability of
every grade. The model is trained here, by stochastic gradients in numpy, scaled by each feature's past ones,, on a bounded sample of labelled documents (``train_docs`` with
the smallest hashes); every document is scored on its whole text.

Defined results: null text counts as empty and is scored on its shape alone; labels with a null doc_id or grade are left
out, of several labels of a document the lowest grade counts; without labels every grade is equally likely; equal texts
score alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.bytetools import SPACE, groups_of, prefix, span_hash

BUCKETS = 1 << 17
BATCH = 1 << 19

_KIND = np.full(256, 2, dtype=np.uint8)  # 0 white space, 1 letters and digits, 2 the rest
_KIND[SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def featurise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all texts end to end, and where each text's begin (with the end)."""
    lowered = [t.decode("utf-8", "replace").lower().encode("utf-8") for t in texts]
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    capitals = (upper[at[1:]] - upper[at[:-1]]) / np.maximum(np.diff(at) - 1, 1)
    data = np.frombuffer(b" ".join([*lowered, b""]), dtype=np.uint8)
    kind = np.concatenate([[0], _KIND[data], [0]])
    edges = np.flatnonzero(kind[1:] != kind[:-1])
    starts, ends = edges[:-1], edges[1:]
    runs = kind[starts + 1] > 0
    starts, ends = starts[runs], ends[runs]
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in lowered)]))
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    hashed = (span_hash(prefix(data), starts, ends) % np.uint64(BUCKETS - 64)).astype(np.int64) + 64
    n_runs = np.diff(first)
    lengths = np.bincount(owner, weights=ends - starts, minlength=len(texts)) / np.maximum(n_runs, 1)
    keys = np.unique(owner * BUCKETS + hashed)
    distinct = np.bincount(keys // BUCKETS, minlength=len(texts)) / np.maximum(n_runs, 1)
    shapes = [np.minimum(capitals * 16, 15), 16 + np.minimum(distinct * 16, 15), 32 + np.minimum(lengths, 15), 48 + np.minimum(np.log2(n_runs + 1), 15)]
    keys = np.sort(np.concatenate([keys, *(np.arange(len(texts)) * BUCKETS + s.astype(np.int64) for s in shapes)]))
    return keys % BUCKETS, np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)


@dataclass
class Ordinal:
    """weights by feature; thresholds ascending, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        return sums[first[1:]] - sums[first[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, [texts, grades - 1]."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None] - scores[:, None], -40, 40)))


def train(ids: np.ndarray, first: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = 15, batch: int = 128, least_steps: int = 800, rate: float = 0.3, l2: float = 1e-3, least_docs: int | None = None, seed: int = 3) -> Ordinal:
    """Maximum likelihood of the cumulative-link model, thresholds kept in order by positive steps.

    Features of fewer than least_docs training texts keep weight 0 (by default one in 300, from 3 to 20).
    """
    rng = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros(BUCKETS), np.linspace(-1, 1, n_grades - 1)[:1], np.zeros(max(0, n_grades - 2))])
    seen = np.zeros_like(theta)
    if least_docs is None:
        least_docs = min(max(len(grades) // 300, 3), 20)
    common = np.bincount(ids, minlength=BUCKETS) >= least_docs
    keep = common[ids]
    first = np.concatenate([[0], np.cumsum(keep)])[first]
    ids = ids[keep]
    epochs = max(epochs, -(-least_steps // max(1, len(grades) // batch)))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(grades)), max(1, len(grades) // batch)):
            steps = np.exp(theta[BUCKETS + 1 :])
            cut = np.concatenate([[-np.inf], theta[BUCKETS] + np.concatenate([[0.0], np.cumsum(steps)]), [np.inf]])
            size = first[part + 1] - first[part]
            at = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            own = np.repeat(np.arange(len(part)), size)
            s = np.bincount(own, weights=theta[ids[at]], minlength=len(part))
            y = grades[part]
            upper, lower = 1 / (1 + np.exp(np.clip(s - cut[y + 1], -40, 40))), 1 / (1 + np.exp(np.clip(s - cut[y], -40, 40)))
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # d log p by the upper, minus by the lower threshold
            g = np.zeros_like(theta)
            g[:BUCKETS] = np.bincount(ids[at], weights=(du - dl)[own], minlength=BUCKETS)
            by_cut = np.bincount(y, weights=-du, minlength=n_grades)[: n_grades - 1] + np.bincount(y, weights=dl, minlength=n_grades)[1:]
            g[BUCKETS] = by_cut.sum()
            for j in range(n_grades - 2):
                g[BUCKETS + 1 + j] = steps[j] * by_cut[j + 1 :].sum()
            g = g / len(part)
            g[:BUCKETS] += l2 * theta[:BUCKETS]
            seen += g * g
            theta -= rate * g / (np.sqrt(seen) + 1e-8)
    steps = np.exp(theta[BUCKETS + 1 :])
    return Ordinal(theta[:BUCKETS].astype(np.float32), theta[BUCKETS] + np.concatenate([[0.0], np.cumsum(steps)]))


def graded(labels: DataFrame, grade: Column) -> DataFrame:
    """doc_id, grade: the lowest grade of each labelled document."""
    rows = labels.select("doc_id", grade.cast("int").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(documents: DataFrame, grades: DataFrame, n_grades: int, train_docs: int = 16_000) -> Ordinal:
    """grades(doc_id, grade) with grades from 0; only train_docs rows of features reach the driver.

    Of the texts of a repeated doc_id the one with the least hash is learned.
    """
    sample = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)

    def run(batches):
        for batch in batches:
            texts = [b"" if x is None else x for x in batch.column(1).cast(pa.binary()).to_pylist()]
            ids, first = featurise(texts) if texts else (np.empty(0, np.int64), np.zeros(1, np.int64))
            blobs = [ids[a:b].astype("<i4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["grade", "ids"])

    joined = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade")
    joined = joined.agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("grade", "least.text")
    rows = sorted((r["grade"], bytes(r["ids"])) for r in joined.mapInArrow(run, "grade int, ids binary").collect())
    if not rows:
        return Ordinal(np.zeros(BUCKETS, np.float32), -np.log(n_grades / np.arange(1, n_grades) - 1))
    ids = np.concatenate([np.frombuffer(b, "<i4") for _, b in rows]).astype(np.int64)
    first = np.cumsum([0, *(len(b) // 4 for _, b in rows)])
    return train(ids, first, np.clip([g for g, _ in rows], 0, n_grades - 1).astype(np.int64), n_grades)


def rate(documents: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_grade, p_at_least_k for every grade k from 1."""
    n = len(model.thresholds)
    schema = ", ".join(["doc_id long", "expected_grade double", *(f"p_at_least_{k} double" for k in range(1, n + 1))])
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            texts = [b"" if x is None else x for x in batch.column(1).cast(pa.binary()).to_pylist()]
            tails = np.zeros((len(texts), n))
            for lo, hi in groups_of(map(len, texts), BATCH):
                tails[lo:hi] = model.tails(model.scores(*featurise(texts[lo:hi])))
            columns = [tails.sum(axis=1), *tails.T]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in columns)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
