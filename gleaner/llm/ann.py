"""Approximate maximum-inner-product search by score-aware anisotropic quantisation.

Vectors are cut into pairs of components, each coded by four bits. What matters for large inner products is the error
along the vector, so codebooks and codes minimise |r|^2 + (eta - 1) (r . x / |x|)^2 for the residual r of a vector x.
Codebooks are fitted on a bounded sample (``train_rows`` vectors with the smallest hashes); every vector is coded.

A query's table has its products with all centroids. Rows and queries stand in blocks of bounded size; every block of
queries scans the codes of every block of rows, two codes a byte looked up at once. The ``rerank`` best of a block by their
codes are scored exactly in double precision; the k-th of these scores is what a row of the block has to reach.

Codes alone miss rows where many vectors lie closer together than the codes tell apart. So a check follows: by Cauchy and
Schwarz a row's product is its rough one plus at most |q| |r|, r being what its codes leave of it (``reach``, kept with
them). Rows that cannot reach the k-th score by that are left out; the others are bounded again by their product in single
precision and its rounding error, and those still in doubt are scored in double precision too. So nothing nearer is missed,
whatever the vectors. What the first bound leaves out depends on them: much in clusters, little in random directions.

Of equal vectors in a block only rows of the smallest ids can be among the k best (k of an id, 2 k in all), so further
copies are not coded. Blocks move the codes, reaches and vectors of rows once for each block of queries.

Defined results: vectors that are null, zero, or hold a null, NaN or infinity take no part, as query or candidate, nor do
vectors whose length is not the commonest one; equal scores go to the smaller vec_id; a null vec_id takes no part; rows
with a repeated vec_id are candidates each, but none for a query of that id; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from gleaner.llm.common import cut

CENTROIDS = 16
ROW_BLOCK, QUERY_BLOCK = 1 << 20, 1 << 18  # components, so bytes are bounded for any length of vectors
ENCODED, TABLES = 4096, 32
LEAST = 1e-37


@dataclass
class Quantiser:
    """books: [subspaces, CENTROIDS, width], for vectors padded to subspaces * width components."""

    books: np.ndarray
    eta: float

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.books.shape[0] * self.width - x.shape[1])))

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes [rows, subspaces]: nearest centroids, then coordinate descent on the anisotropic loss."""
        x = self.pad(x)
        s, w = self.books.shape[0], self.width
        parts = x.reshape(len(x), s, w)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), s, w)
        gap = parts[:, :, None, :] - self.books[None]
        square, along = (gap**2).sum(axis=3), np.einsum("nskw,nsw->nsk", gap, unit)
        codes = square.argmin(axis=2)
        rows = np.arange(len(x))
        parallel = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for j in range(s):
                rest = parallel - along[rows, j, codes[:, j]]
                codes[:, j] = (square[:, j] + (self.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
                parallel = rest + along[rows, j, codes[:, j]]
        return codes.astype(np.uint8)

    def reach(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far a product with a unit vector can be from the one by the codes, rounding in single precision included."""
        x = self.pad(x)
        back = self.books[np.arange(self.books.shape[0]), codes].reshape(len(x), -1)
        size = np.linalg.norm(x, axis=1) + np.linalg.norm(back, axis=1)
        return np.linalg.norm(x - back, axis=1) + rounding(x.shape[1]) * size + LEAST

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products for every two neighbouring codes, [queries, byte, 256]."""
        q = self.pad(queries).reshape(len(queries), self.books.shape[0], self.width)
        one = np.einsum("qsw,skw->qsk", q, self.books)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def rounding(n: int) -> float:
    """A bound of the relative error of sums of n products in single precision."""
    return (n + 8) * 2.0**-22


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms whose squares don't leave the range of doubles."""
    most = np.abs(x).max(axis=1)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def packed(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] * CENTROIDS + codes[:, 1::2]


def train(x: np.ndarray, rounds: int = 6, threshold: float = 0.2, seed: int = 5) -> Quantiser:
    """Alternate codes and codebooks; the codebooks of a round solve one weighted least-squares problem."""
    width = 2
    pairs = -(-x.shape[1] // (2 * width))
    s = 2 * pairs
    eta = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    x = np.pad(x, ((0, 0), (0, s * width - x.shape[1])))
    n = len(x)
    start = rng.permutation(n)[np.arange(CENTROIDS) % n]
    books = x[start].reshape(CENTROIDS, s, width).transpose(1, 0, 2).copy()
    books += rng.standard_normal(books.shape) * 1e-6
    found = Quantiser(books, eta)
    norm = np.linalg.norm(x, axis=1)
    unit = x / norm[:, None]
    for turn in range(rounds):
        codes = Quantiser(found.books, 1.0 if turn < 2 else eta).encode(x).astype(np.int64)
        size = s * CENTROIDS * width
        place = (np.arange(s)[None, :] * CENTROIDS + codes)[:, :, None] * width + np.arange(width)
        count = np.bincount(place.ravel(), minlength=size).astype(np.float64)
        right = np.bincount(place.ravel(), weights=x.ravel(), minlength=size)
        along = np.zeros((n, size))
        np.put_along_axis(along, place.reshape(n, -1), unit, axis=1)
        weight = 0.0 if turn < 2 else eta - 1
        left = weight * (along.T @ along)
        left[np.diag_indices(size)] += count + 1e-6
        right = right + weight * (along.T @ norm) + 1e-6 * found.books.ravel()
        found = Quantiser(np.linalg.solve(left, right).reshape(s, CENTROIDS, width), eta)
    return found


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    bad: Column = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    rows = rows.where(~bad & F.exists("embedding", lambda v: v != 0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nth(head: np.ndarray) -> np.ndarray:
    """The place of each row after the head of its group."""
    place = np.arange(len(head))
    return place - np.maximum.accumulate(np.where(head, place, 0))


def needed(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows, in order of ids, without those that equal vectors of smaller ids keep from the k best: k of an id stay, 2 k in all, as a query may rule out one id."""
    x = np.ascontiguousarray(x)
    kind = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    new = lambda c: np.concatenate([[True], c[1:] != c[:-1]])
    order = order[_nth(new(kind[order]) | new(ids[order])) < k]
    return np.sort(order[_nth(new(kind[order])) < 2 * k])


def _coded(rows: DataFrame, n: int, coder: Quantiser, scale: float, k: int, kind: str) -> DataFrame:
    """One row a block of rows: row_block, and in order of vec_id the vec ids, packed codes, reaches and vectors of those needed."""

    def run(group: pa.Table) -> pa.Table:
        group = group.select(["row_block", "vec_id", "embedding"]).sort_by("vec_id")
        ids, x = group["vec_id"].to_numpy(), _matrix(group["embedding"]).astype(kind)
        keep = needed(x, ids, k)
        ids, x, codes, reach = ids[keep], x[keep], [], []
        for at in range(0, len(x), ENCODED):
            part = x[at : at + ENCODED].astype(np.float64) / scale
            found = coder.encode(part)
            codes.append(packed(found))
            reach.append(coder.reach(part, found))
        blobs = [ids.astype("<i8"), np.ascontiguousarray(np.concatenate(codes).T), np.concatenate(reach).astype("<f8"), x]
        return pa.table({"row_block": pa.array([group["row_block"][0].as_py()], pa.int32()), **{name: [b.tobytes()] for name, b in zip(("ids", "codes", "reach", "vectors"), blobs, strict=True)}})

    dealt = rows.withColumn("row_block", F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("row_block").applyInArrow(lambda g: run(g), "row_block int, ids binary, codes binary, reach binary, vectors binary")


def _asked(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """One row a block of queries: their row ids, vec ids and vectors."""

    def run(group: pa.Table) -> pa.Table:
        blobs = [group["row_id"].to_numpy().astype("<i8"), group["vec_id"].to_numpy().astype("<i8"), _matrix(group["embedding"]).astype(kind)]
        return pa.table({name: [b.tobytes()] for name, b in zip(("q_rows", "q_ids", "queries"), blobs, strict=True)})

    dealt = rows.withColumn("query_block", F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("query_block").applyInArrow(lambda g: run(g), "q_rows binary, q_ids binary, queries binary")


def _scan(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rough products of a query with all rows, by its table."""
    rough = np.zeros(codes.shape[1], dtype=np.float32)
    for products, code in zip(table, codes, strict=True):
        rough += products[code]
    return rough


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) * q).sum(axis=1)


def _below(score: float, unit: float) -> np.float32:
    """A score in the given unit, less what single precision may add to it."""
    return np.float32(score / unit - 1e-6 * abs(score / unit) - LEAST)


def nearest(coder: Quantiser, scale: float, q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, codes: np.ndarray, reach: np.ndarray, x: np.ndarray, k: int, rerank: int):
    """For each query the places of the block's k best rows, and their exact scores."""
    size = lengths(x.astype(np.float64))
    top, slack = size.max(), (rounding(x.shape[1]) * size / size.max() + LEAST).astype(np.float32)
    single, reach = (x / top).astype(np.float32), reach.astype(np.float32)
    near = min(len(ids), rerank + 1)
    for at in range(0, len(queries), TABLES):
        asked = queries[at : at + TABLES].astype(np.float64)
        length = lengths(asked)
        unit = asked / length[:, None]
        least = np.full(len(asked), -np.inf)
        open_ = np.empty((len(asked), len(ids)), dtype=bool)
        for i, table in enumerate(coder.tables(unit)):
            rough = _scan(table, codes)
            best = np.argpartition(rough, len(ids) - near)[len(ids) - near :]
            best = best[ids[best] != q_ids[at + i]]
            if len(best) >= k:
                least[i] = np.partition(_products(asked[i], x[best]), len(best) - k)[len(best) - k]
            open_[i] = ~(rough + reach < _below(least[i], length[i] * scale))
        some = np.flatnonzero(open_.any(axis=0))
        rest, more = (single, slack) if len(some) == len(ids) else (single[some], slack[some])
        close = unit.astype(np.float32) @ rest.T + more
        for i in range(len(asked)):
            at_last = some[open_[i, some] & ~(close[i] < _below(least[i], length[i] * top))]
            at_last = at_last[ids[at_last] != q_ids[at + i]]
            score = _products(asked[i], x[at_last])
            first = np.lexsort((ids[at_last], -score))[:k]
            yield at + i, at_last[first], score[first]


def search(vectors: DataFrame, is_query: Column, k: int = 20, rerank: int = 240, train_rows: int = 3000) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows found."""
    rows = cut(cut(usable(vectors)).withColumn("row_id", F.monotonically_increasing_id()))
    n_rows, n_queries = rows.count(), rows.where(is_query).count()
    sample = [r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).select("embedding").collect()]
    if not sample:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where(F.lit(False))
    sample = np.array(sample, dtype=np.float64)
    scale, width = float(lengths(sample).max()), sample.shape[1]
    coder = train(sample / scale)
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    query_blocks = max(1, -(-n_queries * width // QUERY_BLOCK))
    few = min(-(-n_rows // ENCODED), -(-rows.sparkSession.sparkContext.defaultParallelism // query_blocks))  # a small table keeps all cores busy
    row_blocks = max(few, -(-n_rows * width // ROW_BLOCK))
    asked = _asked(rows.where(is_query), query_blocks, kind).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    work = cut(_coded(rows, row_blocks, coder, scale, k, kind)).join(asked, "row_block").select("q_rows", "q_ids", "queries", "ids", "codes", "reach", "vectors")
    work = work.repartition(min(row_blocks * query_blocks, 100_000))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q_rows, q_ids, queries, ids, codes, reach, x = (c[row].as_py() for c in batch.columns)
                q_rows, q_ids, ids = (np.frombuffer(b, "<i8") for b in (q_rows, q_ids, ids))
                queries, x = np.frombuffer(queries, kind).reshape(len(q_ids), -1), np.frombuffer(x, kind).reshape(len(ids), -1)
                codes, reach = np.frombuffer(codes, np.uint8).reshape(-1, len(ids)), np.frombuffer(reach, "<f8")
                found = [(np.full(len(at), q_rows[i]), np.full(len(at), q_ids[i]), ids[at], score) for i, at, score in nearest(coder, scale, q_ids, queries, ids, codes, reach, x, k, rerank)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_row", "query_id", "vec_id", "score"])

    scored = work.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
