"""Language identification by a bidirectional gated recurrent network over bytes.

A small GRU reads the UTF-8 bytes of a text from both sides and labels every byte; the byte probabilities are
pooled into one distribution for the document. The network is trained here, in numpy, by backpropagation
through time, on a bounded sample of labelled snippets (``docs_per_language`` documents of each language, chosen
by hash, ``snippets`` windows of each). Prediction reads every byte of every text, in windows that overlap by
``HALO`` bytes on each side so that no byte is labelled without context.

Gates use the piecewise-linear sigmoid and tanh, in training and prediction alike.

Defined results: a null text, or one without any letter, is ``und`` with score 0; equal texts get equal results;
no labelled row leaves every document ``und``; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.bytetools import groups_of

HALO, CORE = 16, 224
WINDOW = HALO + CORE + HALO
#: Slices of a language in which the training documents are picked, so that one language is many tasks.
SALTS = 30
UND = "und"


@dataclass
class Net:
    """e: byte to gate inputs, u: hidden to gates, b: recurrent bias, by direction; v, c: the output layer."""

    labels: list[str]
    e: list[np.ndarray]
    u: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    @property
    def hidden(self) -> int:
        return self.u[0].shape[0]


def _init(labels: list[str], hidden: int, rng: np.random.Generator) -> Net:
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Net(
        labels,
        [draw(256, 3 * hidden, scale=0.4) for _ in range(2)],
        [draw(hidden, 3 * hidden, scale=0.6 / np.sqrt(hidden)) for _ in range(2)],
        draw(2 * hidden, len(labels), scale=0.3),
        np.zeros(len(labels), dtype=np.float32),
    )


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, hidden: int):
    """One GRU step on [batch, 3 hidden] inputs; returns the new state and what backpropagation needs."""
    a = h @ u
    gates = x[:, : 2 * hidden] + a[:, : 2 * hidden]
    gates *= 0.25
    gates += 0.5
    np.clip(gates, 0.0, 1.0, out=gates)
    r, z = gates[:, :hidden], gates[:, hidden:]
    n = a[:, 2 * hidden :] * r
    n += x[:, 2 * hidden :]
    np.clip(n, -1.0, 1.0, out=n)
    new = h - n
    new *= z
    new += n
    return new, (r, z, n, a[:, 2 * hidden :], h)


def _run(net: Net, k: int, windows: np.ndarray, keep: bool = False):
    """States of direction k for windows [batch, time], as [time, batch, hidden]; with keep also the tape."""
    hidden, (batch, time) = net.hidden, windows.shape
    steps = range(time) if k == 0 else range(time - 1, -1, -1)
    states = np.empty((time, batch, hidden), dtype=np.float32)
    h, tape = np.zeros((batch, hidden), dtype=np.float32), {}
    for t in steps:
        h, kept = _step(net.e[k].take(windows[:, t], axis=0), h, net.u[k], hidden)
        states[t] = h
        if keep:
            tape[t] = kept
    return states, tape


def _softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _gradients(net: Net, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time of the mean cross-entropy over all non-padding bytes."""
    hidden, (batch, time) = net.hidden, windows.shape
    runs = [_run(net, k, windows, keep=True) for k in range(2)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
    p = _softmax(both @ net.v + net.c)
    p[:, np.arange(batch), target] -= 1.0
    p *= (windows.T != 0)[:, :, None] / max(1, int((windows != 0).sum()))
    grads = [np.zeros_like(net.e[0]), np.zeros_like(net.e[1]), np.zeros_like(net.u[0]), np.zeros_like(net.u[1])]
    grads += [np.tensordot(both, p, ((0, 1), (0, 1))), p.sum(axis=(0, 1))]
    back = p @ net.v.T
    for k in range(2):
        u, tape, dh = net.u[k], runs[k][1], np.zeros((batch, hidden), dtype=np.float32)
        dx_all = np.empty((time, batch, 3 * hidden), dtype=np.float32)
        for t in range(time - 1, -1, -1) if k == 0 else range(time):
            r, z, n, an, h = tape[t]
            dh = dh + back[t][:, k * hidden : (k + 1) * hidden]
            dn = dh * (1 - z) * (np.abs(n) < 1)
            dz = dh * (h - n) * 0.25 * ((z > 0) & (z < 1))
            dr = dn * an * 0.25 * ((r > 0) & (r < 1))
            dx_all[t] = np.concatenate([dr, dz, dn], axis=1)
            da = np.concatenate([dr, dz, dn * r], axis=1)
            grads[2 + k] += h.T @ da
            dh = dh * z + da @ u.T
        flat = dx_all.reshape(-1, 3 * hidden)
        codes = windows.T.ravel()
        for j in range(3 * hidden):
            grads[k][:, j] = np.bincount(codes, weights=flat[:, j], minlength=256)
    return grads


def train(snippets: list[bytes], languages: list[str], hidden: int = 8, epochs: int = 4, batch: int = 128, least_steps: int = 160, seed: int = 7) -> Net:
    """Adam over shuffled batches of fixed windows; small samples get smaller batches and more epochs."""
    labels = sorted(set(languages))
    rng = np.random.default_rng(seed)
    net = _init(labels, hidden, rng)
    width = max((len(s) for s in snippets), default=1)
    x = np.zeros((len(snippets), width), dtype=np.uint8)
    for i, s in enumerate(snippets):
        x[i, : len(s)] = np.frombuffer(s, dtype=np.uint8)
    y = np.array([labels.index(v) for v in languages], dtype=np.int64)
    batch = min(batch, max(16, len(x) // 8))
    epochs = max(epochs, -(-least_steps // max(1, len(x) // batch)))
    params = [net.e[0], net.e[1], net.u[0], net.u[1], net.v, net.c]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / (epochs + 1))
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            t += 1
            grads = _gradients(net, x[part], y[part])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows [n, WINDOW] of all texts, zero where there is no text, and the text of each."""
    counts = np.fromiter((max(1, -(-len(s) // CORE)) for s in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), counts)
    buffer = np.zeros(HALO + int(counts.sum()) * CORE + len(texts) * HALO + WINDOW, dtype=np.uint8)
    starts = HALO + (np.cumsum(counts) - counts) * CORE + np.arange(len(texts)) * HALO
    for s, at in zip(texts, starts, strict=True):
        buffer[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[owner] + nth * CORE - HALO
    return np.lib.stride_tricks.sliding_window_view(buffer, WINDOW)[first], owner


class Labeller:
    """Prediction with features first and windows last, so that every numpy step runs along contiguous memory."""

    def __init__(self, net: Net):
        h = net.hidden
        scale = np.concatenate([np.full(2 * h, 0.25), np.ones(h)]).astype(np.float32)[:, None]
        shift = np.concatenate([np.full(2 * h, 0.5), np.zeros(h)]).astype(np.float32)[:, None]
        self.hidden, self.labels = h, len(net.labels)
        self.e = [np.ascontiguousarray(e.T * scale + shift) for e in net.e]
        self.u = [np.ascontiguousarray(u.T * scale) for u in net.u]
        self.v = [np.ascontiguousarray(net.v[:h].T), np.ascontiguousarray(net.v[h:].T)]
        self.c = net.c[:, None]

    def _states(self, k: int, codes: np.ndarray) -> np.ndarray:
        """States of the core positions in one direction, [CORE, hidden, windows]."""
        h, (time, n) = self.hidden, codes.shape
        out = np.empty((CORE, h, n), dtype=np.float32)
        x, a = np.empty((3 * h, n), dtype=np.float32), np.empty((3 * h, n), dtype=np.float32)
        state = np.zeros((h, n), dtype=np.float32)
        r, z, fresh = x[:h], x[h : 2 * h], x[2 * h :]
        gates, back = x[: 2 * h], a[2 * h :]
        for t in range(HALO + CORE) if k == 0 else range(time - 1, HALO - 1, -1):
            np.take(self.e[k], codes[t], axis=1, out=x, mode="clip")
            np.matmul(self.u[k], state, out=a)
            gates += a[: 2 * h]
            np.maximum(gates, 0.0, out=gates)
            np.minimum(gates, 1.0, out=gates)
            back *= r
            fresh += back
            np.maximum(fresh, -1.0, out=fresh)
            np.minimum(fresh, 1.0, out=fresh)
            state -= fresh
            state *= z
            state += fresh
            if HALO <= t < HALO + CORE:
                out[t - HALO] = state
        return out

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Label probabilities of every core byte, [CORE, labels, windows]; padding bytes have zeros."""
        codes = np.ascontiguousarray(windows.T).astype(np.intp)
        p = np.matmul(self.v[0], self._states(0, codes))
        p += np.matmul(self.v[1], self._states(1, codes))
        p += self.c
        np.exp(p, out=p)
        p *= ((codes[HALO : HALO + CORE] != 0) / p.sum(axis=1)).astype(np.float32)[:, None]
        return p


def predict(net: Net, texts: list[bytes], batch: int = 512) -> np.ndarray:
    """Pooled label distribution of each text, [texts, labels]."""
    pooled, labeller = np.zeros((len(texts), len(net.labels))), Labeller(net)
    for lo, hi in groups_of([max(1, -(-len(s) // CORE)) for s in texts], batch):
        windows, owner = _windows(texts[lo:hi])
        for at in range(0, len(windows), batch):
            part = labeller.positions(windows[at : at + batch]).sum(axis=0).T
            np.add.at(pooled, lo + owner[at : at + batch], part)
    return pooled / np.maximum(pooled.sum(axis=1, keepdims=True), 1e-9)


def training_sample(labelled: DataFrame, docs_per_language: int = 300, snippets: int = 3, width: int = 128) -> list[tuple[str, str]]:
    """(lang, snippet) pairs: of each language the documents with the smallest hashes, evenly spaced windows of each."""
    at = lambda i: (F.length("text") - width) * F.lit(i) / F.lit(max(1, snippets - 1))
    cuts = [F.substring(F.col("text"), (F.greatest(at(i), F.lit(0)) + 1).cast("int"), F.lit(width)) for i in range(snippets)]
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("text").alias("hash"), F.array(*cuts).alias("cuts"))
    order = Window.partitionBy("lang", F.pmod("hash", F.lit(SALTS))).orderBy("hash", "cuts")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= -(-docs_per_language // SALTS))
    picked = rows.select("lang", F.explode("cuts").alias("snippet")).where(F.col("snippet") != "").orderBy("lang", "snippet")
    return [(r["lang"], r["snippet"]) for r in picked.collect()]


def _bytes(text: str) -> bytes:
    """UTF-8 with blanks for NUL, which marks where there is no text."""
    return text.encode("utf-8").replace(b"\0", b" ")


def fit(labelled: DataFrame, hidden: int = 8, **sample) -> Net | None:
    found = training_sample(labelled, **sample)
    if not found:
        return None
    return train([_bytes(s) for _, s in found], [v for v, _ in found], hidden=hidden)


def identify(documents: DataFrame, net: Net | None, text: str = "text") -> DataFrame:
    """documents with lang_pred and score; the text column alone decides them. Input columns of these names are replaced."""
    documents = documents.drop("lang_pred", "score", "_has_letter")
    known: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return documents.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})
    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            has = np.array(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool)
            values = batch.column(batch.schema.get_field_index(text))
            rows = np.flatnonzero(has)
            texts = [_bytes(values[int(i)].as_py()) for i in rows]
            p = predict(net, texts) if texts else np.zeros((0, len(net.labels)))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, dtype=int)
            named, score = np.full(len(has), UND, dtype=object), np.zeros(len(has))
            named[rows] = [net.labels[k] for k in best]
            score[rows] = p[np.arange(len(p)), best] if len(p) else []
            columns = batch.columns[:-1] + [pa.array(named, pa.string()), pa.array(np.clip(score, 0.0, 1.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return documents.withColumn("_has_letter", known).mapInArrow(run, schema)
