"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Pieces of full length are a
sequence each. The others are dealt to partitions by hash and packed there by best-fit decreasing. Dual feasible
functions bound each partition's bins from below. Then every partition hands its loosest bins back, more of them the
wider its gap, and the returned pieces meet in fewer partitions and are packed again, until the count reaches the
bound over all pieces or one partition has seen the rest. If after ``max_rounds`` more is left than a partition takes, the
last round packs it where it is, in as many partitions as it needs.

Defined results: null text counts as empty, so its piece holds the end id alone; repeated rows are packed each;
equal lengths are taken in doc_id and piece order; no rows give no sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut
from gleaner.llm.tokenfile import _texts
from gleaner.llm.tokens import WORD_BPE, tokenizer

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, vocabulary: str = WORD_BPE, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for doc_id, ids in zip(names, tokenizer(vocabulary).encode(_texts(batch.column(1))), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(run, _PIECE)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The best dual-feasible-function bound on bins for counts of each length.

    u(k) rounds a length down to k-ths of the capacity unless (k+1) times it divides evenly; the cut-off function
    drops lengths under a threshold and fills up those above its complement. Both keep every feasible bin feasible,
    so the rounded-up sum bounds the bins.
    """
    if not counts:
        return 0
    size = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(x)] for x in size], dtype=np.int64)
    best = -(-int((size * n).sum()) // capacity)
    for k in range(1, 41):
        scaled = (k + 1) * size
        mapped = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((mapped * n).sum()) // (capacity * k)))
    for low in size[size <= capacity // 2]:
        mapped = np.where(size > capacity - low, capacity, np.where(size < low, 0, size))
        best = max(best, -(-int((mapped * n).sum()) // capacity))
    large = int(n[size * 2 > capacity].sum())
    return max(best, large)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of lengths in the given (decreasing) order: bin and offset of each, fill of each bin.

    Open bins are kept by free space; a bit set of the spaces in use gives the tightest one that fits.
    """
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fills = 0, []
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, size in enumerate(lengths.tolist()):
        fitting = used >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                used &= ~(1 << space)
        else:
            space, b = capacity, len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += size
        left = space - size
        if left:
            by_space[left].append(b)
            used |= 1 << left
    return where, offset, np.array(fills, dtype=np.int64)


def _pack_part(rows: pa.Table, capacity: int, spread: int, last: bool) -> pa.Table:
    lengths = rows["length"].to_numpy()
    keys = [rows[c].combine_chunks().fill_null(-1).to_numpy() for c in ("piece", "doc_id")]
    order = np.lexsort((*keys, -lengths))
    rows, lengths = rows.take(pa.array(order)), lengths[order]
    where, offset, fills = best_fit(lengths, capacity)
    size, n = np.unique(lengths, return_counts=True)
    gap = len(fills) - lower_bound(dict(zip(size.tolist(), n.tolist(), strict=True)), capacity)
    back = np.zeros(len(fills), dtype=bool)
    if not last:
        loose = np.argsort(fills, kind="stable")[: spread * (1 + gap)]
        back[loose[fills[loose] < capacity]] = True
    for name, values in (("bin", where), ("offset", offset), ("open", back[where]), ("gap", np.full(len(where), gap, dtype=np.int64))):
        rows = rows.append_column(name, pa.array(values))
    return rows


def _one_argument(f):
    """Spark counts parameters to see whether a function wants the key."""
    return lambda group: f(group)


def pack(rows: DataFrame, capacity: int = 4096, part_pieces: int = 20_000, spread: int = 24, max_rounds: int = 8) -> DataFrame:
    """rows of pieces() with sequence_id and offset.

    A round keeps some spread * (1 + gap) open sequences of each part_pieces pieces, less than a hundredth of them, so
    max_rounds rounds, which nothing comes near, are for more pieces than there can be: 8 for 20,000 * 100 ** 7.
    rows are read several times and must be cut first: pieces are dealt by their place in them, too, so that equal ones
    spread over the parts. The lengths' histogram, at most capacity rows, is all that the driver sees.
    """
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole, left = counts.pop(capacity, 0), sum(counts.values())
    bound = lower_bound(counts, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = rows.where(F.col("length") == capacity).select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = rows.where(F.col("length") < capacity)
    schema = f"{_PIECE}, part long, bin long, offset long, open boolean, gap long"
    packed = 0
    for turn in range(max_rounds):
        parts = max(1, -(-left // part_pieces))
        last = parts == 1 or turn + 1 == max_rounds
        dealt = todo.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "start", "length", F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)).alias("part"))

        def run(group: pa.Table, last: bool = last) -> pa.Table:
            return _pack_part(group, capacity, spread, last)

        placed = cut(dealt.groupBy("part").applyInArrow(_one_argument(run), schema))
        sequence = F.lit((turn + 1) << 56) + F.col("part") * (1 << 24) + F.col("bin")
        stats = placed.agg(F.sum(F.col("open").cast("int")).alias("open"), F.count_distinct(F.when(~F.col("open"), sequence)).alias("bins"), F.count_distinct(sequence).alias("all")).first()
        finished = last or packed + (stats["all"] or 0) <= bound
        keep = placed if finished else placed.where(~F.col("open"))
        done = done.unionByName(keep.select(*columns, sequence.alias("sequence_id"), "offset"))
        if finished:
            break
        packed, left = packed + stats["bins"], stats["open"]
        todo = placed.where("open")
    return done


def pack_documents(documents: DataFrame, vocabulary: str = WORD_BPE, capacity: int = 4096, end_id: int = 1, **options) -> DataFrame:
    return pack(cut(pieces(documents, vocabulary, capacity, end_id)), capacity, **options)
