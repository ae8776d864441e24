"""Blocks of documents and the exchange of hashes between them.

A block is a slice of the documents by hash. Blocks send their distinct hashes, packed and dealt by hash range, to one
task a range, and get back what the whole corpus says about those that matter, for instance that they occur more than
once. Every hash is counted; nothing is sampled. Traffic is a few bytes a hash. Keys must be spread evenly over the key
space, as mixed hashes are; then no range gathers more than its share, and a hash in every document is one entry a block.

A chain of exchanges reads the blocks again at each step. Spark shuffles the text once and reuses that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.bytetools import pack_sorted, unpack_sorted
from gleaner.llm.common import blocks_for, give_back, text_bytes

#: Text in a block: small enough for little memory, larger for corpora where very many blocks would make entries tiny.
BLOCK_BYTES, LARGEST_BLOCK, MANY_BLOCKS = 4 << 20, 128 << 20, 4000
SENT = "range int, block int, keys binary, counts binary, extra binary"
ANSWER = "block int, kind int, keys binary, values binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}

#: One sent or answered entry: its block, its sorted keys, their counts (none: handed through) and further bytes.
Entry = tuple[int, np.ndarray, np.ndarray, bytes]


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in ddl.split(", ")])


def to_table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = arrow_schema(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows_place(documents: DataFrame) -> list[Column]:
    """What tells equal rows apart and is the same however often they are read: file and row where they come from files, else nothing."""
    try:
        documents.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return []
    return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]


def blocked(documents: DataFrame, least: int = BLOCK_BYTES, keep: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """documents(doc_id, text) dealt into blocks, with others to keep, and the number of blocks. Null text becomes empty.

    Rows of files are dealt by their place there, too, so that rows that are equal in all columns spread over the blocks.
    Rows that come from elsewhere, such as a join, have no place that lasts; equal ones of these share a block.
    """
    total = text_bytes(documents)
    size = min(max(least, total // MANY_BLOCKS), LARGEST_BLOCK)
    n = blocks_for(documents.sparkSession, total, size)
    block = F.pmod(F.xxhash64("doc_id", "text", *rows_place(documents)), F.lit(n)).cast("int")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep, block.alias("block"))
    return rows.repartition(n, "block"), n


def block_texts(block: pa.Table) -> list[bytes]:
    return block["text"].cast(pa.binary()).to_pylist()


def send(block: int, keys: np.ndarray, counts: np.ndarray, ranges: int, bits: int, extra: np.ndarray | None = None) -> list[tuple]:
    """Rows of SENT for the sorted keys of a block, cut into ranges of the key space."""
    edges = np.searchsorted(keys, np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << bits) // ranges))
    cuts = [0, *edges.tolist(), len(keys)]
    small = np.minimum(counts, 255).astype(np.uint8)
    return [
        (i, block, pack_sorted(keys[lo:hi]), small[lo:hi].tobytes(), b"" if extra is None else extra[lo:hi].tobytes())
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        if hi > lo
    ]


def hand_through(block: int, keys: np.ndarray, values: np.ndarray, ranges: int) -> tuple:
    """A row of SENT that comes back to its block as it is."""
    return block % ranges, block, pack_sorted(keys), b"", values.tobytes()


def one_argument(f: Callable) -> Callable:
    """Spark counts parameters to see whether a function wants the key. Freed memory goes back after each group."""

    def run(group: pa.Table) -> pa.Table:
        out = f(group)
        give_back()
        return out

    return run


def two_arguments(f: Callable) -> Callable:
    """The same for a group and what came to it."""

    def run(group: pa.Table, other: pa.Table) -> pa.Table:
        out = f(group, other)
        give_back()
        return out

    return run


def reduce_ranges(
    sent: DataFrame, ranges: int, resolve: Callable[[list[Entry]], list[tuple[int, np.ndarray, np.ndarray]]], stats: Callable[[list[Entry]], np.ndarray] | None = None
) -> DataFrame:
    """ANSWER rows: kind 1 from resolve over all entries of a range (block, sorted keys, values), kind 0 handed through.

    With stats also one row of kind 2 a range, for block -1, with that range's figures.
    """

    def run(group: pa.Table) -> pa.Table:
        rows, entries = [], []
        for block, keys, counts, extra in zip(*(group[c].to_pylist() for c in ("block", "keys", "counts", "extra")), strict=True):
            if counts:
                entries.append((block, unpack_sorted(keys), np.frombuffer(counts, dtype=np.uint8).astype(np.int64), extra))
            else:
                rows.append((block, 0, keys, extra))
        if stats:
            rows.append((-1, 2, b"", stats(entries).tobytes()))
        rows += [(block, 1, pack_sorted(keys), values.tobytes()) for block, keys, values in resolve(entries)]
        return to_table(rows, ANSWER)

    return sent.repartition(ranges, "range").groupBy("range").applyInArrow(one_argument(run), ANSWER)


def received(answers: pa.Table, kind: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a kind that came to a block, sorted, and their values."""
    rows = [(unpack_sorted(k), np.frombuffer(v, dtype=dtype)) for t, k, v in zip(*(answers[c].to_pylist() for c in ("kind", "keys", "values")), strict=True) if t == kind]
    if not rows:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=dtype)
    keys, values = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing) -> np.ndarray:
    """values of the asked keys, missing where there is none; keys are sorted."""
    if not len(keys):
        return np.full(len(asked), missing, dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], values.dtype.type(missing))


def split_by_block(blocks: np.ndarray, keys: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Answers of one range sorted by block, then key."""
    order = np.lexsort((keys, blocks))
    blocks, keys, values = blocks[order], keys[order], values[order]
    cuts = np.flatnonzero(np.diff(blocks)) + 1
    if not len(blocks):
        return []
    firsts = [0, *cuts.tolist()]
    return [(int(blocks[lo]), keys[lo:hi], values[lo:hi]) for lo, hi in zip(firsts, [*firsts[1:], len(blocks)], strict=True)]


def join_entries(entries: list[Entry]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, keys and counts of all entries, end to end."""
    if not entries:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return (
        np.repeat(np.array([e[0] for e in entries]), [len(e[1]) for e in entries]),
        np.concatenate([e[1] for e in entries]),
        np.concatenate([e[2] for e in entries]),
    )
