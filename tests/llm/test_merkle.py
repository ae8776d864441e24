"""The manifest against trees built level by level."""

import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle
from gleaner.llm.q_merkle import op12_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([merkle.digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 26, 27, 28, 80, 250])
def test_traversal_is_the_tree(n):
    leaves = [merkle.digest(str(i)) for i in range(n)]
    tree = levels(leaves)
    height = merkle.height_of(n)
    assert height == len(tree) - 1 and merkle.top_of(leaves, height) == tree[-1][0]
    assert list(merkle.traverse(leaves, height)) == [path(tree, i) for i in range(n)]


def test_a_block_below_further_levels_is_folded_alone():
    leaves = [merkle.digest(str(i)) for i in range(10)]
    top = merkle.top_of(leaves, 5)
    assert all(merkle.folded(leaf, p) == top for leaf, p in zip(leaves, merkle.traverse(leaves, 5), strict=True))


def test_few_digests_are_kept(monkeypatch):
    most = 0

    def low(self):
        nonlocal most
        most = max(most, len(self.stack))
        return self.stack[-1][0] if self.stack else self.level

    monkeypatch.setattr(merkle._Ahead, "low", low)
    list(merkle.traverse([str(i) for i in range(3**6)], 6))
    assert most <= 3 * 6


def expected(rows):
    text = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, body: merkle.digest("".join(map(text, (r[0], r[3], r[2], r[4], body))))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[name] = levels([x[0] for x in groups[name]])
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        for i, (own, r) in enumerate(groups[name]):
            way = path(trees[name], i) + path(top, at)
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            seen = own if odd or r[1] is None else leaf(r, r[1].replace("\n", ""))
            seen = merkle.folded(seen, way)
            out.append((r[0], own, trees[name][-1][0], top[-1][0], merkle.digest("".join(a + b for a, b in way)), seen, seen == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_equals_trees(spark, tmp_path, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "SPAN", 3**height)
    rows = [(i, f"a\nb{i}" if i % 3 else "ab", "en", "hot", i) for i in range(40)]
    rows += [(7, "same\n", "en", "twice", 1)] * 5 + [(1, None, None, None, None), (None, "x\ny", None, "s", 1), (None, None, None, "s", None)]
    rows += [(2, "ü" * 50_000 + "\n", "de", "ä", 3), (3, "", "", "", 0), (900, "only\n", "fr", "Z", 1)]
    spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_merkle_manifest(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_merkle_manifest(spark, str(tmp_path)).count() == 0


def test_equal_rows_are_spread(spark):
    rows = spark.range(2000).select(F.lit("s").alias("g"), F.lit(1).alias("key"), F.lit("d").alias("digest"), F.monotonically_increasing_id().alias("row"))
    placed = merkle.placed(rows, "g", ["key", "digest", "row"])
    assert sorted(r.pos for r in placed.collect()) == list(range(2000))
    assert placed.select("n").distinct().collect()[0].n == 2000
