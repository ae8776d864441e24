"""A manifest of a table as a tree of digests, with an authentication path for every row.

Rows of a group are leaves in the order of a key; every three consecutive nodes of a level become their parent. The groups'
roots, in the order of their names, become the leaves of one more tree. Rows get their places from a sort over ranges, so a
group may lie in many partitions. A group is cut into aligned blocks of ARITY ** HEIGHT leaves: a block is one whole subtree,
and its root is a leaf of the levels above, which are done in the same way until a block holds a group. Then each block is
passed once more, with the path of its root at its head, and a traversal hands on the path of one leaf after the other.

The traversal keeps for each level the run of nodes around the current leaf. The next run of a level is computed ahead by a
stack of nodes; each leaf pays for a fixed number of steps, which go to the stack whose lowest node is lowest. So few stacks
are under way at any time, and a block of n leaves keeps some log(n) digests beside its leaves.

Defined results: null fields are written as '-'; rows without a key come first; equal rows are leaves each, next to each
other, in any order, and rows of one key go by their leaf; a null group is a group of its own and the first; a lone leaf is
its group's root, and a lone group's root the root of all; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.llm.common import cut

ARITY, HEIGHT = 3, 7
SPAN = ARITY**HEIGHT
PATH = "lefts array<string>, rights array<string>"

#: Siblings of one node at one level: the digests left of it and right of it, end to end.
Level = tuple[str, str]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(name: str) -> Column:
    """A field as leaves hold it: '-' for null, else its bytes' count, ':' and the value."""
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*fields), 256)


def height_of(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class _Ahead:
    """A run of one level, computed by a stack: a step takes a leaf or folds the last nodes into their parent."""

    def __init__(self, leaves: Sequence[str], sizes: list[int], level: int, run: int):
        self.leaves, self.sizes, self.level = leaves, sizes, level
        self.at = run * ARITY ** (level + 1)
        self.stack: list[tuple[int, int, str]] = []
        self.done = self.at >= len(leaves)

    def low(self) -> int:
        return self.stack[-1][0] if self.stack else self.level

    def step(self) -> None:
        if self.stack and self.stack[-1][0] < self.level and self._ends(*self.stack[-1][:2]):
            level, last, _ = self.stack[-1]
            first = len(self.stack) - last % ARITY - 1
            self.stack[first:] = [(level + 1, last // ARITY, digest("".join(d for _, _, d in self.stack[first:])))]
        else:
            self.stack.append((0, self.at, self.leaves[self.at]))
            self.at += 1
        level, last, _ = self.stack[-1]
        self.done = level == self.level and self._ends(level, last)

    def _ends(self, level: int, last: int) -> bool:
        return last % ARITY == ARITY - 1 or last == self.sizes[level] - 1

    def nodes(self) -> list[str]:
        while not self.done:
            self.step()
        return [d for _, _, d in self.stack]


def top_of(leaves: Sequence[str], height: int) -> str:
    """The node height levels above the leaves of a block; a node without siblings is still folded."""
    stack: list[list[str]] = [[] for _ in range(height + 1)]
    for leaf in leaves:
        stack[0].append(leaf)
        for level in range(height):
            if len(stack[level]) < ARITY:
                break
            stack[level + 1].append(digest("".join(stack[level])))
            stack[level].clear()
    for level in range(height):
        if stack[level]:
            stack[level + 1].append(digest("".join(stack[level])))
            stack[level].clear()
    return stack[height][0]


def traverse(leaves: Sequence[str], height: int) -> Iterator[list[Level]]:
    """The path of each leaf of a block, one after the other, up to the node height levels above."""
    sizes = [len(leaves)]
    for _ in range(height):
        sizes.append(-(-sizes[-1] // ARITY))
    runs = [_Ahead(leaves, sizes, level, 0).nodes() for level in range(height)]
    ahead = [_Ahead(leaves, sizes, level, 1) for level in range(height)]
    steps = height + height // 2 + 1
    for i in range(len(leaves)):
        path, own = [], i
        for run in runs:
            own, place = divmod(own, ARITY)
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
        yield path
        for level in range(height):
            own, place = divmod(i + 1, ARITY ** (level + 1))
            if place or i + 1 == len(leaves):
                break
            runs[level] = ahead[level].nodes()
            ahead[level] = _Ahead(leaves, sizes, level, own + 1)
        for _ in range(steps):
            begun = min((a for a in ahead if not a.done), key=_Ahead.low, default=None)
            if begun is None:
                break
            begun.step()


def folded(leaf: str, path: Sequence[Level]) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with pos, their place (from 0) in their group, and n, its size; sorted over ranges, so no group is one task's."""
    ordered = cut(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order))
    numbered = ordered.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    parts = numbered.groupBy("_part", group).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by).alias("n"))
    return numbered.join(parts, ["_part", group]).withColumn("pos", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def _by_block(rows: DataFrame, columns: Sequence[str], each: Callable, schema: str) -> DataFrame:
    """each((g, block), its rows as tuples in order of pos) over all blocks; a partition's rows stream through, block by block."""
    rows = rows.select("g", "block", *columns).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        out: list[tuple] = []

        def told():
            made = [list(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

        key, own = None, []
        for batch in batches:
            for g, block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, block) != key:
                    if own:
                        out += each(key, own)
                    key, own = (g, block), []
                    if len(out) >= SPAN:
                        yield told()
                own.append(row)
        if own:
            out += each(key, own)
        if out:
            yield told()

    return rows.mapInArrow(run, schema)


def _with_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / SPAN).cast("long"))


def tops(nodes: DataFrame) -> DataFrame:
    """nodes(g, pos, n, digest) one block each: g, pos, n, digest of the roots of their blocks, the nodes of the levels above."""

    def each(key, own):
        _, n, _ = own[0]
        height = height_of(n) if n <= SPAN else HEIGHT
        return [(*key, -(-n // SPAN), top_of([d for _, _, d in own], height))]

    return _by_block(_with_blocks(nodes), ["pos", "n", "digest"], each, "g string, pos long, n long, digest string")


def climbed(nodes: DataFrame) -> DataFrame:
    """nodes(g, pos, n, digest) with the path of each (lefts, rights) and the root of its group: g, pos, lefts, rights, root."""
    nodes = cut(nodes.select("g", "pos", "n", "digest"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    rows = _with_blocks(nodes).select("g", "block", "pos", "n", "digest", *_no_path())
    if most > SPAN:
        rows = rows.unionByName(_heads(climbed(tops(nodes))), allowMissingColumns=True)

    def each(key, own):
        head, own = (own[0], own[1:]) if own[0][0] < 0 else (None, own)
        n = own[0][1]
        leaves = [d for _, _, d, *_ in own]
        height = height_of(n) if n <= SPAN else HEIGHT
        lefts, rights, root = head[3:] if head else ([], [], top_of(leaves, height))
        paths = zip(own, traverse(leaves, height), strict=True)
        return [(key[0], pos, [p[0] for p in path] + lefts, [p[1] for p in path] + rights, root) for (pos, *_), path in paths]

    return _by_block(rows, ["pos", "n", "digest", "lefts", "rights", "root"], each, f"g string, pos long, {PATH}, root string")


def _no_path() -> list[Column]:
    none = F.lit(None)
    return [none.cast("array<string>").alias("lefts"), none.cast("array<string>").alias("rights"), none.cast("string").alias("root")]


def _heads(paths: DataFrame) -> DataFrame:
    """Paths of blocks as rows that stand before the blocks' own rows."""
    return paths.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), *[c for c in paths.columns if c not in ("g", "pos")])


def manifest(rows: DataFrame, group: str, key: str, leaf: Column, altered: Column) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    altered is the leaf of a row as it is found later, null where that is the leaf itself; folded_root is what it and the
    row's path give, and proof_sha256 the digest of the path's siblings, level by level from left to right.
    """
    g = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(F.col(key).alias("key"), g.alias("g"), leaf.alias("digest"), altered.alias("altered"), F.monotonically_increasing_id().alias("row"))
    leaves = cut(placed(leaves, "g", ["key", "digest", "row"]).select("g", "pos", "n", "key", "digest", "altered"))
    blocks = cut(climbed(tops(leaves)))
    subroots = blocks.where("pos = 0").select("g", F.col("root").alias("digest"))
    every = placed(subroots.withColumn("all", F.lit("")), "all", ["g"])
    names = cut(every.select("g", "pos", "n", "digest"))
    shared = climbed(names.withColumn("g", F.lit(""))).select("pos", F.col("lefts").alias("_lefts"), F.col("rights").alias("_rights"), F.col("root").alias("_root"))
    shared = names.select("g", "pos").join(shared, "pos").drop("pos")
    path = [F.concat("lefts", "_lefts").alias("lefts"), F.concat("rights", "_rights").alias("rights")]
    heads = _heads(blocks.join(shared, "g").select("g", "pos", *path, F.col("root").alias("subroot"), F.col("_root").alias("root")))
    body = _with_blocks(leaves).unionByName(heads, allowMissingColumns=True)

    def each(_, own):
        (*_, lefts, rights, subroot, root), *own = own
        upper = list(zip(lefts, rights, strict=True))
        siblings = "".join(left + right for left, right in upper)
        n, found = own[0][1], [d for _, _, _, d, *_ in own]
        out = []
        for (_, _, name, own_leaf, changed, *_), path in zip(own, traverse(found, height_of(n) if n <= SPAN else HEIGHT), strict=True):
            proof = digest("".join(left + right for left, right in path) + siblings)
            seen = folded(own_leaf if changed is None else changed, [*path, *upper])
            out.append((name, own_leaf, subroot, root, proof, seen, seen == root))
        return out

    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _by_block(body, ["pos", "n", "key", "digest", "altered", "lefts", "rights", "subroot", "root"], each, schema)
