"""Vectorised numpy helpers over UTF-8 bytes: words, rolling hashes, packed sorted hashes.

Hashes are polynomials modulo 2**64 with an odd base, read off prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
STRETCH = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII white space, bytes 9 to 13 and 32.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
        have += step
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = (_geometric(_BASE, size), _geometric(_INVERSE, size))
    return _powers[size]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[i] over data[:i]; span_hash reads any span off them."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= powers(len(data) + 1)[0][: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of every data[start:end]; equal bytes have equal hashes wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hash of every word, over stretches of about STRETCH bytes, so that sums and powers stay small for any text."""
    if not len(starts) or int(ends[-1] - starts[0]) <= STRETCH:
        first = int(starts[0]) if len(starts) else 0
        part = data[first : int(ends[-1])] if len(starts) else data[:0]
        return span_hash(prefix(part), starts - first, ends - first)
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, first + STRETCH, "right")))
        out[at:to] = span_hash(prefix(data[first : int(ends[to - 1])]), starts[at:to] - first, ends[at:to] - first)
        at = to
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as differences in byte planes, which compress well."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, dtype=np.uint64)
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def groups_of(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Half-open index ranges whose sizes sum to at most limit (a larger item stands alone)."""
    start, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if i >= start:
        yield start, i + 1


def joined(texts: list[bytes], pad: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts with pad zero bytes after each; the starts and ends of the texts in it."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + pad) - pad
    gap = bytes(pad)
    return np.frombuffer(gap.join([*texts, b""]), dtype=np.uint8), ends - sizes, ends
