"""Nearest vectors on rows that codes alone don't tell apart, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ann

RNG = np.random.default_rng(7)
DIM = 16


def clusters(n, spread):
    return RNG.standard_normal((4, DIM))[RNG.integers(0, 4, n)] + spread * RNG.standard_normal((n, DIM))


GIVEN = {
    "tight clusters": clusters(4000, 1e-3),
    "one far offset": 50.0 + RNG.standard_normal((3000, DIM)),
    "norms of many sizes": RNG.standard_normal((3000, DIM)) * np.exp(6 * RNG.standard_normal((3000, 1))),
    "near and exact copies": np.concatenate([np.repeat(clusters(3, 1.0), 700, axis=0), clusters(1, 1.0) + 1e-6 * RNG.standard_normal((900, DIM)), RNG.standard_normal((600, DIM))]),
    "one large component": np.concatenate([1e4 * RNG.standard_normal((3000, 1)), RNG.standard_normal((3000, DIM - 1))], axis=1),
    "very small and very large": RNG.standard_normal((3000, DIM)) * np.where(np.arange(3000) % 2, 1e-30, 1e18)[:, None],
    "a sparse table": np.where(RNG.random((3000, DIM)) < 0.1, 1.0, 0.0),
}


@pytest.mark.parametrize("name", list(GIVEN))
def test_all_of_the_nearest_are_found(spark, monkeypatch, name):
    monkeypatch.setattr(ann, "ROW_BLOCK", 1100 * DIM)
    x = GIVEN[name].astype(np.float32)
    ids = np.arange(len(x)) * 3 + 1
    RNG.shuffle(ids)
    given = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.search(given, F.col("vec_id") % 50 == 0, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x64 = x.astype(np.float64)
    used = np.flatnonzero((x64 != 0).any(axis=1))
    asked = [i for i in used if ids[i] % 50 == 0]
    assert set(found) == {int(ids[i]) for i in asked}
    for i in asked:
        score = (x64[used] * x64[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids[used], -score)) if ids[used][j] != ids[i]][:20]
        own = sorted(found[ids[i]])
        assert [v for _, v, _ in own] == ids[used][order].tolist()
        assert [s for _, _, s in own] == score[order].tolist()


def test_copies_kept():
    x = np.ones((50, 2), dtype=np.float32)
    assert ann.needed(x, np.arange(50), 3).tolist() == [0, 1, 2, 3, 4, 5]
    assert ann.needed(x, np.repeat([1, 2, 3], [40, 5, 5]), 3).tolist() == [0, 1, 2, 40, 41, 42]
    x[::2] = 2
    assert ann.needed(x, np.arange(50), 1).tolist() == [0, 1, 2, 3]
