"""Connected components of a link table, by contraction of partitions and, where that stalls, star steps.

Links are sorted into ranges of about PART links, so a centre's links stand together, and a centre with very many is cut
over several ranges. Each range joins its own links by union-find and names every node by the least it reaches. Nodes
that stand in several ranges link those names, which makes a much smaller table of links between names; its components
are found in the same way and carried back. Long chains with scattered ids may not shrink: then large-star and small-star
steps alternate to their fixed point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

PART = 20_000
LABELS = "id long, component long"


def _joined(batches):
    """(id, component) of a partition's links (a, b): each node and the least node of its local component."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        way = []
        while (up := root.setdefault(x, x)) != x:
            way.append(x)
            x = up
        for y in way:
            root[y] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    ids = np.fromiter(root, dtype=np.int64, count=len(root))
    names = np.fromiter((top(int(x)) for x in ids), dtype=np.int64, count=len(ids))
    for lo in range(0, len(ids), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(names[part])], names=["id", "component"])


def components(links: DataFrame, part: int = PART) -> DataFrame:
    """links(a, b) of long ids -> (id, component): the smallest id that links reach, for every id with a link."""
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return _contracted(edges, edges.count(), part)


def _contracted(edges: DataFrame, n: int, part: int) -> DataFrame:
    parts = -(-n // part)
    if parts <= 1:
        return cut(edges.coalesce(1).mapInArrow(_joined, LABELS))
    named = cut(edges.repartitionByRange(parts, "a", "b").mapInArrow(_joined, LABELS))
    least = cut(named.groupBy("id").agg(F.min("component").alias("component"), F.max("component").alias("other")))
    torn = least.where("component <> other").select("id", F.col("component").alias("a"))
    between = cut(named.join(torn, "id").where("component <> a").select("a", F.col("component").alias("b")).distinct())
    left = between.count()
    least = least.drop("other")
    if not left:
        return least
    above = _contracted(between, left, part) if left <= 0.8 * n else _stars(between)
    above = above.select(F.col("id").alias("component"), F.col("component").alias("above"))
    return cut(least.join(above, "component", "left").select("id", F.coalesce("above", "component").alias("component")))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def _stars(links: DataFrame) -> DataFrame:
    """components of links by large-star and small-star steps, repeated until nothing changes."""
    edges = cut(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    before, state = None, _fingerprint(edges)
    while state != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _fingerprint(edges)
    ends = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends).groupBy("id").agg(F.min("component").alias("component"))
