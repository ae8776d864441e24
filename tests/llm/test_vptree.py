"""Hard negatives against all pairs."""

import math
import random

import pytest

from gleaner.llm import vptree
from gleaner.llm.q_hardneg import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, x int"


def expected(rows):
    usable = []
    for i, (vec, x, label, *_) in enumerate(rows):
        if vec is None or label is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        usable.append((i, vec, (label + 1) % 10 if vec % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    out = []
    for i, vec, label, x in usable:
        if vec % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), other, j, theirs == label) for j, other, theirs, y in usable if j != i and len(y) == len(x))
        for p, positive, _, _ in [s for s in scored if s[3]][:5]:
            fits = [s for s in scored if not s[3] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(vec, positive, n, s[1], -p, -s[0]) for n, s in enumerate(fits, 1)]
    return sorted(out)


def compare(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, dim, scale=1.0, seed=3):
    rng = random.Random(seed)
    return [(i, [float(f"{rng.gauss(0.3, 1) * scale:.3f}") for _ in range(dim)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("block", "bucket", "dim"), [(8192, 64, 8), (40, 4, 3), (100, 1, 16)])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, block, bucket, dim):
    monkeypatch.setattr(vptree, "BLOCK", block)
    monkeypatch.setattr(vptree, "BUCKET", bucket)
    rows = vectors(1200, dim)
    assert compare(spark, tmp_path, rows) == expected(rows)


def test_nulls_repeated_rows_lengths_and_large_values(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vptree, "BLOCK", 50)
    rows = vectors(300, 4) + [(1, [0.5, 0.5, 0.5, 0.5], 1)] * 150 + [(100, [0.5, 0.5, 0.5, 0.5], 1)] * 3
    rows += [(200, [0.1, 0.2], 2), (201, [0.2, 0.2], 2), (202, [0.1, 0.1], 3), (300, [1.0], 0)]
    rows += [(None, [1.0] * 4, 1), (400, None, 1), (500, [1.0] * 4, None), (600, [math.nan] * 4, 1), (700, [1.0, None, 1.0, 1.0], 1), (800, [], 1), (900, [0.0] * 4, 2)]
    assert compare(spark, tmp_path, rows) == expected(rows)


def test_scores_beyond_doubles(spark, tmp_path):
    rows = [(i, [float(2**17 + i), 3.0, -float(2**16)], i % 3) for i in range(0, 150)] + [(100, [float(2**18), 1.0, 1.0], 1)]
    assert compare(spark, tmp_path, rows) == expected(rows)


def test_no_rows(spark, tmp_path):
    assert compare(spark, tmp_path, []) == []


def test_queue_leaves_out_subtrees(monkeypatch):
    """On rows that stand in clusters more than half of them are never looked at."""
    import numpy as np

    monkeypatch.setattr(vptree, "BUCKET", 64)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.integers(-4000, 4000, (40, 6)), 100, axis=0) + rng.integers(-20, 20, (4000, 6))
    m2 = float((x.astype(float) ** 2).sum(axis=1).max())
    order, tree = vptree.build(vptree.Space.of(x, m2))
    ids = np.arange(4000)[order].astype(np.int64)
    block = vptree.Block(m2, 6, ids.tobytes(), ids.tobytes(), (ids % 2).tobytes(), x[order].astype("<i4").tobytes(), 4, tree.tobytes())
    looked = []
    scored = block.scored
    monkeypatch.setattr(block, "scored", lambda lo, hi, *rest: looked.append(hi - lo) or scored(lo, hi, *rest))
    q = x[17]
    best = int((q @ q) * 1.1)
    got = [s for s, _, _ in block.nearest(17, q, 1, False, best // 2, best, 10)]
    want = sorted((int(s) for i, s in enumerate(x @ q) if i % 2 == 0 and i != 17 and best // 2 <= s <= best), reverse=True)[:10]
    assert got == want and sum(looked) < 2000
