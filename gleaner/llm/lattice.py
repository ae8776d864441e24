"""Marginal probabilities of words over all their segmentations into pieces, for many words at once.

A word is written with the boundary mark in front. Its lattice has an arc for every vocabulary piece that equals a
stretch of it; single bytes after the mark have fallback arcs. The forward recursion in log space sums over all paths.
Words of equal length are handled together, so each step is one numpy operation over all of them; words of more than LONG
bytes one by one, in stretches of STRETCH bytes, with a numpy step for each length of a piece, so the work grows with their
length, and what is held of a word are its bytes and 8 or 16 bytes a position.
"""

from __future__ import annotations

import math
import os
from array import array
from collections.abc import Iterator

import numpy as np

MARK = "▁".encode()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FILTER_BITS = 21
_PREFIX, _PIECE = 1, 2
PIECES = "piece_bpe_32k.model"
LOG_ZERO = -1e30
LONG, STRETCH = 64, 1 << 14


def vocabulary_path(vocabulary: str) -> str:
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def read_pieces(vocabulary: str = PIECES) -> tuple[list[bytes | int], np.ndarray]:
    """Pieces as bytes, fallback bytes as their number, and log weights from the vocabulary's own scores.

    Scores of merge-ranked vocabularies are negative ranks; by Zipf's law a piece of rank r weighs 1 / (r + 3).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
    pieces: list[bytes | int] = []
    scores = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        pieces.append(int(name[3:5], 16) if model.is_byte(i) else name.encode())
        scores.append(0.0 if model.is_byte(i) else model.get_score(i))
    scores = np.array(scores)
    ranked = bool((scores == np.round(scores)).all())
    log_weight = -np.log(3.0 - scores) if ranked else scores
    byte = np.array([isinstance(p, int) for p in pieces])
    log_weight[byte] = log_weight[~byte].min() if (~byte).any() else 0.0
    return pieces, log_weight - np.log(np.exp(log_weight).sum())


def _prefix_hashes(piece: bytes) -> list[int]:
    """Hashes of the first byte, the first two, and so on to the whole piece."""
    out, h = [], 0
    for b in piece:
        h = (h * int(_BASE) + b + 1) & ((1 << 64) - 1)
        out.append(h)
    return out


class Lattice:
    def __init__(self, pieces: list[bytes | int], log_p: np.ndarray):
        self.log_p = np.asarray(log_p, dtype=np.float64)
        text = [i for i, p in enumerate(pieces) if isinstance(p, bytes)]
        prefixes = [_prefix_hashes(pieces[i]) for i in text]
        hashes = np.array([p[-1] for p in prefixes], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(text, dtype=np.int64)[order]
        self.byte_id = np.full(256, -1, dtype=np.int64)
        for i, p in enumerate(pieces):
            if isinstance(p, int):
                self.byte_id[p] = i
        self.longest = max((len(pieces[i]) for i in text), default=1)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=np.uint8)
        self.filter[self._slot(np.array([h for p in prefixes for h in p], dtype=np.uint64))] = _PREFIX
        self.filter[self._slot(self.keys)] |= _PIECE

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _FILTER_BITS)).astype(np.intp)

    def _arcs(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, piece ids) of all arcs of words x [words, bytes], by end, then start."""
        n = x.shape[1]
        codes = np.ascontiguousarray(x.T).astype(np.uint64) + np.uint64(1)
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for start in [0, *range(len(MARK), n)]:
            h, alive = np.zeros(len(x), dtype=np.uint64), np.arange(len(x))
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = h * _BASE + codes[end - 1][alive]
                told = self.filter[self._slot(h)]
                go_on = np.flatnonzero(told)  # others begin no piece
                if not len(go_on):
                    break
                h, alive, told = h[go_on], alive[go_on], told[go_on]
                hit = np.flatnonzero(told & _PIECE)
                if not len(hit) or 0 < end < len(MARK):
                    continue
                at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
                same = self.keys[at] == h[hit]
                if same.any():
                    found[start, end] = alive[hit[same]], self.ids[at[same]]
        rows = np.arange(len(x))
        for end in range(len(MARK), n + 1):
            for start in range(max(0, end - self.longest), end):
                if (start, end) in found:
                    yield start, end, *found[start, end]
            if end - 1 >= len(MARK):
                ids = self.byte_id[x[:, end - 1]]
                own = ids >= 0
                yield end - 1, end, rows[own], ids[own]

    def _forward(self, x: np.ndarray, arcs: list) -> np.ndarray:
        alpha = np.full((x.shape[1] + 1, len(x)), LOG_ZERO)
        alpha[0] = 0.0
        for start, end, words, ids in arcs:
            alpha[end, words] = np.logaddexp(alpha[end, words], alpha[start, words] + self.log_p[ids])
        return alpha

    def log_likelihood(self, words: list[bytes]) -> np.ndarray:
        """Natural-log marginal probability of each word."""
        out = np.empty(len(words))
        for at, x in self._by_length(words):
            if x.shape[1] > LONG:
                out[at] = [self._along(row)[-1] for row in x]
            else:
                out[at] = self._forward(x, list(self._arcs(x)))[-1]
        return out

    def _stretches(self, x: np.ndarray, backwards: bool = False) -> Iterator[tuple[list[tuple[int, int, int]], list[float]]]:
        """Arcs (start, end, piece) of one long word and their weights, a stretch of STRETCH ends at a time, by end, then start."""
        n, mark = len(x), len(MARK)
        for lo in sorted(range(0, n, STRETCH), reverse=backwards):
            hi, first = min(n, lo + STRETCH), max(0, lo + 1 - self.longest)
            part = x[first:hi]
            codes, h = part.astype(np.uint64) + np.uint64(1), np.zeros(len(part), dtype=np.uint64)
            own = np.arange(max(lo, mark), hi)
            starts, ends, ids = [own], [own + 1], [self.byte_id[x[own]]]
            for size in range(1, min(len(part), self.longest) + 1):
                h = h[: len(part) - size + 1] * _BASE + codes[size - 1 :]
                hit = np.flatnonzero(self.filter[self._slot(h)] & _PIECE)
                begin = hit + first
                own = ((begin == 0) | (begin >= mark)) & (begin + size >= mark) & (begin + size > lo)
                hit, begin = hit[own], begin[own]
                at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
                same = self.keys[at] == h[hit]
                starts.append(begin[same])
                ends.append(begin[same] + size)
                ids.append(self.ids[at[same]])
            start, end, piece = (np.concatenate(c) for c in (starts, ends, ids))
            start, end, piece = (c[piece >= 0] for c in (start, end, piece))
            order = np.lexsort((start, end))
            yield list(zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), strict=True)), self.log_p[piece[order]].tolist()

    def _along(self, x: np.ndarray) -> array:
        """The forward values of all positions of one long word, 8 bytes each; arcs are held for one stretch."""
        alpha = array("d", [LOG_ZERO]) * (len(x) + 1)
        alpha[0] = 0.0
        for arcs, weights in self._stretches(x):
            for (a, b, _), w in zip(arcs, weights, strict=True):
                alpha[b] = _log_add(alpha[b], alpha[a] + w)
        return alpha

    def _expected_along(self, x: np.ndarray, times: float, out: np.ndarray) -> None:
        alpha = self._along(x)
        beta = array("d", [LOG_ZERO]) * len(alpha)
        beta[-1] = 0.0
        for arcs, weights in self._stretches(x, backwards=True):
            used = np.empty(len(arcs))
            for k in range(len(arcs) - 1, -1, -1):
                a, b, _ = arcs[k]
                path = weights[k] + beta[b]
                used[k] = math.exp(min(alpha[a] + path - alpha[-1], 0.0)) * times
                beta[a] = _log_add(beta[a], path)
            np.add.at(out, [i for _, _, i in arcs], used)

    def expected_counts(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over words that occur so many times."""
        out = np.zeros(len(self.log_p))
        for at, x in self._by_length(words):
            if x.shape[1] > LONG:
                for row, t in zip(x, times[at], strict=True):
                    self._expected_along(row, t, out)
                continue
            arcs = list(self._arcs(x))
            alpha = self._forward(x, arcs)
            beta = np.full_like(alpha, LOG_ZERO)
            beta[-1] = 0.0
            total = alpha[-1]
            for start, end, rows, ids in reversed(arcs):
                path = self.log_p[ids] + beta[end, rows]
                used = np.exp(np.minimum(alpha[start, rows] + path - total[rows], 0.0)) * times[at[rows]]
                out += np.bincount(ids, weights=used, minlength=len(out))
                beta[start, rows] = np.logaddexp(beta[start, rows], path)
        return out

    @staticmethod
    def _by_length(words: list[bytes], limit: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts):
            if not len(group):
                continue
            n = int(sizes[group[0]]) + len(MARK)
            step = max(1, limit // n)
            for lo in range(0, len(group), step):
                at = group[lo : lo + step]
                yield at, np.frombuffer(b"".join(MARK + words[i] for i in at), dtype=np.uint8).reshape(len(at), n)


def reestimated(log_p: np.ndarray, used: np.ndarray, prior_uses: float) -> np.ndarray:
    """Log probabilities from expected uses and the vocabulary's own scores, which count as prior_uses uses in all."""
    weight = prior_uses * np.exp(log_p) + used
    return np.log(weight / weight.sum())


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > LOG_ZERO else a
