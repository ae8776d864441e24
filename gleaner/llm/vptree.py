"""Hard negatives by inner product: vantage-point trees over norm-augmented integer vectors.

With one more component, sqrt(M^2 - |x|^2) for a row x and 0 for a query q, where M is the longest row's norm, all rows have
norm M, and |q - x|^2 = |q|^2 + M^2 - 2 q.x. Larger scores are smaller distances, and a window of scores is an annulus around
the query. A vantage-point tree splits its rows at the median distance from one of them and keeps the least and largest
distance on either side, which bound the distances of all rows there from a query. So whole subtrees outside the annulus are
left out, and a queue of subtrees and rows, nearest first, hands on one row after the other until enough have a fitting label.

One tree is built at the top, over a bounded sample (``sample`` rows with the smallest hashes), and deals every row into
one of at most LEAVES leaves; it only says who stands near whom. A leaf's rows, cut by hash into blocks of about BLOCK, hence
also where many rows are equal, get a tree each. A query visits the blocks of those leaves whose distances, taken over all
their rows, may meet its annulus. An anchor's positives are looked for in its own leaf first; the last of them bounds the
rest of the search. Scores are exact integers, bounds are floats widened by SLACK, so nothing is missed and nothing approximate.

Defined results: rows whose vec_id, label or vector is null, whose vector is empty or holds a null, NaN or infinity take no
part; vectors meet only those of their own length; equal scores go by vec_id; rows with a repeated vec_id each take part, as
anchors too, and an anchor is no partner of its own row alone; an anchor whose positive has a negative score has no window
and no rows for it; no rows give no rows; other columns are ignored. A score of more than 63 bits is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut

BLOCK, BUCKET, CHUNK = 8192, 256, 1024
LEAVES = 4096
SLACK = 1e-9
EXACT = 2.0**52
LEAST, MOST = -(1 << 62), 1 << 62
FOUND = "q_row long, p_row long, row_id long, vec_id long, score long"
QUERY = ["q_row", "p_row", "label", "same", "least", "most", "k", "x"]
NODE = 8  # first and last row, vantage row (-1: a bucket), least and largest distance inside and outside, first child


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    most = int(np.abs(x).max(initial=0))
    return np.ascontiguousarray(x.astype(next((t for t in (np.int16, np.int32) if most <= np.iinfo(t).max), np.int64)))


@dataclass
class Space:
    """Rows as floats with the component that gives all the norm M."""

    x: np.ndarray
    square: np.ndarray
    extra: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, m2: float) -> Space:
        x = x.astype(np.float64)
        square = (x * x).sum(axis=1)
        return cls(x, square, np.sqrt(np.maximum(m2 - square, 0.0)))

    def distances(self, vantage: int, rows: np.ndarray) -> np.ndarray:
        gap = self.square[rows] + self.square[vantage] - 2 * (self.x[rows] @ self.x[vantage])
        return np.sqrt(np.maximum(gap + (self.extra[rows] - self.extra[vantage]) ** 2, 0.0))


def build(space: Space, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the nodes of the tree over it."""
    order, rng = np.arange(len(space.x)), np.random.default_rng(seed)
    nodes = [[0, len(order), -1, 0, 0, 0, 0, -1]]
    at = 0
    while at < len(nodes):
        lo, hi = nodes[at][:2]
        if hi - lo > BUCKET:
            own = order[lo:hi]
            vantage = int(own[rng.integers(hi - lo)])
            d = space.distances(vantage, own)
            by = np.argsort(d, kind="stable")
            middle = (hi - lo) // 2
            near, far = d[by[:middle]], d[by[middle:]]
            if d[by[0]] < d[by[-1]]:
                order[lo:hi] = own[by]
                nodes[at] = [lo, hi, vantage, near[0], near[-1], far[0], far[-1], len(nodes)]
                nodes += [[lo, lo + middle, -1, 0, 0, 0, 0, -1], [lo + middle, hi, -1, 0, 0, 0, 0, -1]]
        at += 1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    tree = np.array(nodes, dtype=np.float64)
    inner = tree[:, 2] >= 0
    tree[inner, 2] = place[tree[inner, 2].astype(np.int64)]
    return order, tree


class Block:
    """Rows in the order of their tree."""

    def __init__(self, m2: float, dim: int, rows: bytes, ids: bytes, labels: bytes, vectors: bytes, width: int, tree: bytes):
        self.m2 = m2
        self.rows, self.ids, self.labels = (np.frombuffer(b, np.int64) for b in (rows, ids, labels))
        whole = np.frombuffer(vectors, f"<i{width}").reshape(-1, dim)
        self.x = whole.astype(np.float64 if m2 < EXACT else object)
        self.tree = np.frombuffer(tree, np.float64).reshape(-1, NODE)
        self.nodes = self.tree.tolist()
        self.inner = np.flatnonzero(self.tree[:, 2] >= 0)
        self.vantages = whole[self.tree[self.inner, 2].astype(np.int64)].astype(np.float64)

        self.asker: tuple = ()
        self.told: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def scored(self, lo: int, hi: int, own: int, q: np.ndarray, label: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Negated scores, vec_ids and row_ids of a bucket's rows with a fitting label, best first; kept while the asker stays."""
        if self.asker != (own, same):
            self.asker, self.told = (own, same), {}
        if lo not in self.told:
            fits = np.flatnonzero(((self.labels[lo:hi] == label) == same) & (self.rows[lo:hi] != own)) + lo
            minus = -(self.x[lo:hi] @ q)[fits - lo]
            order = np.lexsort((self.rows[fits], self.ids[fits], minus))
            self.told[lo] = minus[order], self.ids[fits][order], self.rows[fits][order]
        return self.told[lo]

    def nearest(self, own: int, q: np.ndarray, label: int, same: bool, least: int, most: int, k: int) -> Iterator[tuple[int, int, int]]:
        """(score, vec_id, row_id) of rows with a fitting label and a score in the window, best first, at most k of them.

        The queue holds subtrees by the best score that they may have, and of each bucket that was read the next row.
        """
        length = q.astype(np.float64)
        whole = float(length @ length) + self.m2
        slack = SLACK * whole + 1e-6
        reach = np.zeros(len(self.tree))
        reach[self.inner] = np.sqrt(np.maximum(whole - 2 * (self.vantages @ length), 0.0))
        exact = q.astype(self.x.dtype)
        queue: list[tuple] = [(-most, 0, 0, 0, (0.0, np.inf))]
        while queue and k:
            worst, is_row, at, row, more = heapq.heappop(queue)
            if is_row:
                k -= 1
                yield -int(worst), at, row
                found, i, end = more
                if i < end:
                    heapq.heappush(queue, (found[0][i], 1, int(found[1][i]), int(found[2][i]), (found, i + 1, end)))
                continue
            lo, hi, vantage, a, b, c, d, child = self.nodes[at]
            near, far = more
            if vantage < 0:
                found = self.scored(int(lo), int(hi), own, exact, label, same)
                i, end = np.searchsorted(found[0], -most, "left"), np.searchsorted(found[0], -least, "right")
                if i < end:
                    heapq.heappush(queue, (found[0][i], 1, int(found[1][i]), int(found[2][i]), (found, i + 1, end)))
                continue
            r = reach[at]
            for node, inner, outer in ((int(child), a, b), (int(child) + 1, c, d)):
                nearest, farthest = max(near, r - outer, inner - r), min(far, r + outer)
                upper, lower = (whole - nearest * nearest) / 2 + slack, (whole - farthest * farthest) / 2 - slack
                if upper >= least and lower <= most:
                    heapq.heappush(queue, (-min(upper, most), 0, node, 0, (nearest, farthest)))


@dataclass
class Top:
    """The tree at the top: vantages of its inner nodes as a heap of a fixed depth; node i has the children 2i+1 and 2i+2."""

    vantages: np.ndarray
    radius: np.ndarray
    m2: float

    @property
    def depth(self) -> int:
        return (len(self.radius) + 1).bit_length() - 1

    def routed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row and its distances from the vantages on the way, [rows, depth]."""
        x = x.astype(np.float64)
        square = (x * x).sum(axis=1)
        extra = np.sqrt(np.maximum(self.m2 - square, 0.0))
        own = (self.vantages * self.vantages).sum(axis=1)
        more = np.sqrt(np.maximum(self.m2 - own, 0.0))
        node, way = np.zeros(len(x), np.int64), np.empty((len(x), self.depth))
        for level in range(self.depth):
            gap = square + own[node] - 2 * (x * self.vantages[node]).sum(axis=1) + (extra - more[node]) ** 2
            way[:, level] = np.sqrt(np.maximum(gap, 0.0))
            node = 2 * node + 1 + (way[:, level] > self.radius[node])
        return node - len(self.radius), way


def top_tree(x: np.ndarray, m2: float, depth: int, seed: int = 11) -> Top:
    space, rng = Space.of(x, m2), np.random.default_rng(seed)
    n = (1 << depth) - 1
    vantages, radius = np.zeros((n, x.shape[1])), np.zeros(n)
    members = {0: np.arange(len(x))}
    for node in range(n):
        own = members.pop(node)
        vantage = int(own[rng.integers(len(own))]) if len(own) else 0
        vantages[node] = space.x[vantage]
        d = space.distances(vantage, own)
        radius[node] = np.median(d) if len(d) else 0.0
        members[2 * node + 1], members[2 * node + 2] = own[d <= radius[node]], own[d > radius[node]]
    return Top(vantages, radius, m2)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and x, the components of the vectors as integers, of the rows that take part."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    taken = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256))
    return rows.where(taken).select("vec_id", F.col("label").cast("long").alias("label"), x.alias("x"))


class Index:
    """rows(vec_id, label, x) in blocks with trees, and what leaves hold."""

    def __init__(self, rows: DataFrame, sample: int = 16_384):
        self.rows = cut(rows.withColumn("row_id", F.monotonically_increasing_id()))
        square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        told = self.rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m2"))
        dims = told.orderBy(F.desc("n"), "dim").limit(1).collect()
        self.dim, n = (dims[0]["dim"], dims[0]["n"]) if dims else (1, 0)
        self.m2 = self.rows.agg(F.max(square)).first()[0] or 0.0
        depth = min(max(-(-n // BLOCK) - 1, 0).bit_length(), LEAVES.bit_length() - 1)
        drawn = self.rows.where(F.size("x") == self.dim).orderBy(F.xxhash64("vec_id", "row_id"), "row_id").limit(sample if depth else 1)
        seen = np.array([r["x"] for r in drawn.select("x").collect()], dtype=np.float64).reshape(-1, self.dim)
        self.top = top_tree(seen, self.m2, depth)
        self.placed = cut(self._routed())
        way = [F.struct(F.min(F.get("way", F.lit(i))), F.max(F.get("way", F.lit(i)))).alias(f"way_{i}") for i in range(depth)]
        self.leaves = {r["leaf"]: r for r in self.placed.where("leaf >= 0").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *way).collect()}
        self.blocks = cut(self._blocks())

    def _routed(self) -> DataFrame:
        """rows with the leaf they stand in (a negative one for each other length) and the distances on the way."""
        top, dim = self.top, self.dim

        def run(batches):
            for batch in batches:
                x = batch.column("x")
                sizes = np.diff(x.offsets.to_numpy())
                leaf, way = -sizes.astype(np.int64), [[] for _ in sizes]
                main = np.flatnonzero(sizes == dim)
                if len(main):
                    leaf[main], found = top.routed(matrix(x.take(pa.array(main))))
                    for i, d in zip(main, found, strict=True):
                        way[i] = d.tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(way, pa.list_(pa.float64()))], names=["row_id", "vec_id", "label", "x", "leaf", "way"])

        return self.rows.select("row_id", "vec_id", "label", "x").mapInArrow(run, "row_id long, vec_id long, label long, x array<bigint>, leaf long, way array<double>")

    def _blocks(self) -> DataFrame:
        m2 = self.m2
        sizes = self.placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
        dealt = self.placed.drop("way").join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("row_id"), "parts"))

        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("row_id")
            x = matrix(group["x"])
            order, tree = build(Space.of(x, m2))
            blobs = {n: np.ascontiguousarray(group[c].to_numpy()[order].astype(np.int64)) for n, c in (("rows", "row_id"), ("ids", "vec_id"), ("labels", "label"))}
            small = narrow(x[order])
            head = {"leaf": group["leaf"][0].as_py(), "part": group["part"][0].as_py(), "dim": x.shape[1], "width": small.itemsize}
            return pa.table({**{k: pa.array([v], pa.int64()) for k, v in head.items()}, **{k: [b.tobytes()] for k, b in (blobs | {"vectors": small, "tree": tree}).items()}})

        return dealt.groupBy("leaf", "part").applyInArrow(lambda g: run(g), "leaf long, part long, dim long, width long, rows binary, ids binary, labels binary, vectors binary, tree binary")

    def visits(self, queries: DataFrame) -> DataFrame:
        """queries with a row for each leaf whose rows may lie in their window; home is the leaf to leave out, or null."""
        top, dim, m2 = self.top, self.dim, self.m2
        names = np.array(sorted(self.leaves), dtype=np.int64)
        bounds = np.array([[v for i in range(top.depth) for v in self.leaves[int(n)][f"way_{i}"]] for n in names], dtype=np.float64).reshape(len(names), top.depth, 2)
        ways = np.zeros((len(names), top.depth), np.int64)
        node = names + len(top.radius)
        for level in reversed(range(top.depth)):
            node = (node - 1) // 2
            ways[:, level] = node

        def run(batches):
            for batch in batches:
                took, to = [], []
                columns = (batch.column(c).to_pylist() for c in ("x", "least", "most", "home"))
                for i, (x, least, most, home) in enumerate(zip(*columns, strict=True)):
                    if len(x) != dim:
                        found = [] if home is not None else [-len(x)]
                    else:
                        q = np.array(x, dtype=np.float64)
                        whole = float(q @ q) + m2
                        slack = SLACK * whole + 1e-6
                        r = np.sqrt(np.maximum(whole - 2 * (top.vantages @ q), 0.0))[ways]
                        near = np.maximum(r - bounds[:, :, 1], bounds[:, :, 0] - r).max(axis=1, initial=0.0)
                        far = (r + bounds[:, :, 1]).min(axis=1, initial=np.inf)
                        meets = ((whole - near * near) / 2 + slack >= least) & ((whole - far * far) / 2 - slack <= most)
                        found = names[meets & (names != (LEAST if home is None else home))].tolist()
                    took += [i] * len(found)
                    to += found
                picked = batch.take(pa.array(took, pa.int64()))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(to, pa.int64())], names=[*batch.schema.names, "leaf"])

        return queries.select(*QUERY, "home").mapInArrow(run, f"{', '.join(_ddl(queries, QUERY))}, home long, leaf long").drop("home")

    def asked(self, visits: DataFrame, n_queries: int) -> DataFrame:
        """FOUND: what each visit's query finds in the blocks of its leaf. A block and a share of its queries are one stream."""
        m2, chunks = self.m2, max(1, -(-n_queries // CHUNK))
        parts = self.blocks.groupBy("leaf").agg(F.max("part").alias("last"))
        asks = visits.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
        asks = asks.withColumns({"chunk": F.pmod(F.xxhash64("q_row"), F.lit(chunks)), "turn": F.lit(1)})
        heads = self.blocks.withColumns({"chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))), "turn": F.lit(0)})
        both = heads.unionByName(asks, allowMissingColumns=True)
        blob = ["dim", "rows", "ids", "labels", "vectors", "width", "tree"]
        both = both.repartition("leaf", "part", "chunk").sortWithinPartitions("leaf", "part", "chunk", "turn", "q_row").select("turn", *blob, *QUERY)

        def run(batches):
            block = None
            for batch in batches:
                out = []
                for i, turn in enumerate(batch.column(0).to_pylist()):
                    if not turn:
                        block = tuple(batch.column(c)[i].as_py() for c in blob)
                        continue
                    if isinstance(block, tuple):
                        block = Block(m2, *block)
                    own, p_row, label, same, least, most, k, x = (batch.column(c)[i].as_py() for c in QUERY)
                    q = np.array(x, dtype=object if m2 >= EXACT else np.int64)
                    out += [(own, p_row, row, vec, score) for score, vec, row in block.nearest(own, q, label, same, least, most, k)]
                columns = list(zip(*out, strict=True)) if out else [[] for _ in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q_row", "p_row", "row_id", "vec_id", "score"])

        return both.mapInArrow(run, FOUND)


def _ddl(df: DataFrame, names: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f"{n} {kinds[n]}" for n in names]


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, sample: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows(vec_id, label, x).

    A positive is one of an anchor's best other rows of its label; its negatives are the first k rows of other labels whose
    scores lie between low and high hundredths of its own.
    """
    index = Index(rows, sample)
    anchors = cut(index.placed.where(is_anchor).select(F.col("row_id").alias("q_row"), F.col("vec_id").alias("anchor_id"), "label", "x", "leaf"))
    n = anchors.count()
    whole = {"least": F.lit(LEAST).cast("long"), "most": F.lit(MOST).cast("long"), "k": F.lit(positives), "same": F.lit(True), "p_row": F.lit(-1).cast("long")}
    first = cut(_best(index.asked(anchors.withColumns(whole).select("leaf", *QUERY), n), ["q_row"], positives).drop("rank"))
    bound = first.groupBy("q_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).where(F.col("n") >= positives).drop("n")
    rest = anchors.join(bound, "q_row", "left").withColumns(whole | {"least": F.coalesce("last", F.lit(LEAST).cast("long")), "home": F.col("leaf")})
    other = index.asked(index.visits(rest), n)
    best = _best(first.unionByName(other), ["q_row"], positives)
    best = cut(best.select("q_row", F.col("row_id").alias("p_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(38,0)")
    window = {"least": F.ceil(score * low / 100).cast("long"), "most": F.floor(score * high / 100).cast("long"), "k": F.lit(k), "same": F.lit(False), "home": F.lit(None).cast("long")}
    asks = best.join(anchors.drop("leaf"), "q_row").withColumns(window).where("least <= most")
    found = _best(index.asked(index.visits(asks), n * positives), ["q_row", "p_row"], k)
    told = found.select("q_row", "p_row", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = told.join(best, ["q_row", "p_row"]).join(anchors.select("q_row", "anchor_id"), "q_row")
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
