"""Exact removal of repeated substrings by distributed prefix doubling from sparse positions.

Every byte covered by a ``threshold``-byte string that starts at two places, in whatever documents, is removed. Prefix
doubling ranks positions by the string of some length that starts there, and gets the ranks of twice the length from the
pair of ranks at a position and at an offset. Spark sorts the pairs, equal pairs get one rank, and positions whose pair is
unique drop out; offsets grow until the threshold is passed.

A prefilter comes first, because ranking every byte would move the text many times over: of each threshold-long string
only the position with the least hash of threshold / 2 bytes stands for it (winnowing), so equal strings choose equal
positions, about one in threshold / 4 bytes. Starts that choose the same position form a run; what the run's strings cover
is its content.

1. At the chosen positions the first ranks are hashes of an eighth of the threshold, at four offsets. Spark sorts the pairs
   at the small offset, then the pairs of the new ranks at twice the offset. Positions still not unique share a string of
   half the threshold.
2. Spark sorts the runs of those positions by rank and content. Runs that share both repeat entirely. Where a rank has
   several contents, or its string stands in a run twice, one run of each content has to show its starts.
3. Those starts pair the half-threshold rank at p with the one at p + threshold / 2; pairs seen twice are repeats.

Only the first ranks and contents are hashes (two first ranks share a long, so a rank of half the threshold compares 128
bits, a content 64 more, a pair of starts 128); the ranks of later rounds are places in Spark's order. A key has one row a block at most, except for contents,
whose order is cut at will: a rank cut between two tasks simply shows its starts. Long texts are read in stretches of STRETCH
starts; what is held of a text is about ten times its size.

Defined results: null text counts as empty; texts shorter than the threshold keep every byte; equal rows repeat each
other; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import exchange
from gleaner.llm.bytetools import groups_of, joined, mix, powers, prefix, span_hash
from gleaner.llm.common import new_path, remove, written

BATCH, STRETCH = 1 << 19, 1 << 20
LONGEST_RUN = 256
RESOLVED, SUPPLIES = 1, 2
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
RUNS = "id long, content long, n long, periodic boolean, uses long, p0 long, p1 long"
RANKED = "id long, side int, rank long, uses long"
JUDGED = "block int, content long, flags int"


class Ranks:
    """Half-threshold ranks and runs of a batch of texts laid end to end."""

    def __init__(self, texts: list[bytes], threshold: int):
        self.threshold, self.half = threshold, threshold // 2
        self.data, self.starts, self.ends = joined(texts)
        sums = prefix(self.data)
        n, k = len(self.data), self.half
        if n < threshold:
            self.first = self.stop = np.empty(0, dtype=np.int64)
            self.rank = self.v = self.content = np.empty(0, dtype=np.uint64)
            self.leaves = np.empty((2, 0), dtype=np.uint64)
            self.periodic = np.empty(0, dtype=bool)
            return
        self.rank = mix((sums[k:] - sums[:-k]) * powers(n + 1)[1][: n - k + 1])
        width = threshold - k + 1
        low, size = self.rank, 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if width > size:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        valid = np.zeros(len(low) + 2, dtype=np.int8)
        long = self.ends - self.starts >= threshold
        np.add.at(valid, self.starts[long], 1)
        np.add.at(valid, self.ends[long] - threshold + 1, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)[: len(low)]
        change = np.ones(len(low) + 1, dtype=bool)
        change[1:-1] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
        change[self.starts[long]] = True
        edges = np.flatnonzero(change)
        first, stop = edges[:-1], edges[1:]
        keep = valid[first]
        first, stop = first[keep], stop[keep]
        if len(first) and int((stop - first).max()) > LONGEST_RUN:
            pieces = -(-(stop - first) // LONGEST_RUN)
            nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, stop = np.repeat(first, pieces) + nth * LONGEST_RUN, np.repeat(stop, pieces)
            stop = np.minimum(first + LONGEST_RUN, stop)
        self.first, self.stop = first, stop
        self.v = low[first]
        self.content = span_hash(sums, first, stop + (threshold - 1))
        place, self.periodic = self._chosen(width)
        quarter = -(-k // 2)
        size = -(-quarter // 2)
        leaf = [span_hash(sums, place + at, place + at + size) >> np.uint64(32) for at in (0, quarter - size, k - quarter, k - size)]
        self.leaves = np.stack([leaf[i] << np.uint64(32) | leaf[i + 1] for i in (0, 2)])

    def _chosen(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The chosen position of each run, and whether its hash stands at more than one: starts may repeat within the run."""
        window = np.lib.stride_tricks.sliding_window_view(self.rank, width)
        place, periodic = np.empty(len(self.v), dtype=np.int64), np.empty(len(self.v), dtype=bool)
        for at in range(0, len(self.v), 2048):
            part = slice(at, at + 2048)
            least = self.v[part, None]
            place[part] = (window[self.first[part]] == least).argmax(axis=1) + self.first[part]
            last = width - 1 - (window[self.stop[part] - 1][:, ::-1] == least).argmax(axis=1) + self.stop[part] - 1
            periodic[part] = place[part] != last
        return place, periodic

    def pairs(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts in the given runs, the pair of half-threshold ranks of each as one key, and the first rank, which makes the key one-to-one."""
        size = self.stop[runs] - self.first[runs]
        starts = np.repeat(self.first[runs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        own = self.rank[starts]
        return starts, mix(own * np.uint64(3) + mix(self.rank[starts + self.half])), own


def _stretches(text: bytes, threshold: int) -> list[tuple[int, bytes]]:
    """Where a long text is cut, and its parts: each start of a threshold-byte string lies in one of them alone."""
    return [(at, text[at : at + STRETCH + threshold - 1]) for at in range(0, max(1, len(text) - threshold + 1), STRETCH)]


def _batches(block: pa.Table, threshold: int):
    """(first text, last, None, Ranks) of texts together; for each part of a long text (it, next, place, Ranks)."""
    texts = exchange.block_texts(block)
    for lo, hi in groups_of(map(len, texts), BATCH):
        if hi == lo + 1 and len(texts[lo]) > 2 * STRETCH:
            for at, part in _stretches(texts[lo], threshold):
                yield lo, hi, at, Ranks([part], threshold)
        else:
            yield lo, hi, None, Ranks(texts[lo:hi], threshold)


def _runs(block: pa.Table, threshold: int) -> pa.Table:
    """RUNS rows: the distinct runs of a block by half-threshold string (id) and content.

    The first of an id has its first ranks and its uses, two or more for each run that holds the string more than once.
    """
    schema = exchange.arrow_schema(RUNS)
    parts = [(r.v, r.content, r.periodic, r.leaves) for _, _, _, r in _batches(block, threshold)]
    if not sum(len(p[0]) for p in parts):
        return schema.empty_table()
    v, content, periodic, leaves = (np.concatenate(c, axis=-1) for c in zip(*parts, strict=True))
    order = np.lexsort((content, v))
    v, content, periodic, leaves = v[order], content[order], periodic[order], leaves[:, order]
    new_v = np.concatenate([[True], v[1:] != v[:-1]])
    head = np.flatnonzero(new_v | np.concatenate([[True], content[1:] != content[:-1]]))
    head_v = np.flatnonzero(new_v)
    uses = np.zeros(len(v), dtype=np.int64)
    uses[head_v] = np.add.reduceat(1 + periodic.astype(np.int64), head_v)
    ids = (np.int64(block["block"][0].as_py()) << np.int64(32)) + np.cumsum(new_v) - 1
    n = np.diff(np.append(head, len(v)))
    columns = [ids[head], content[head].view(np.int64), n, np.logical_or.reduceat(periodic, head), uses[head], *leaves[:, head].view(np.int64)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _whole_groups(batches, keys: int):
    """Columns of sorted rows in pieces that cut no group of equal first columns, and whether a piece is the first and the last."""
    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = columns if held is None else [np.concatenate(c) for c in zip(held, columns, strict=True)]
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns[:keys]]))
        end = int(other[-1]) + 1 if len(other) else 0
        if end:
            yield [c[:end] for c in columns], first, False
            first = False
        held = [c[end:] for c in columns]
    if held is not None:
        yield held, first, True


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _rerank(batches, keys: int):
    """Sorted (id, side, uses) behind keys -> RANKED: the place of each pair in the order, without pairs used once."""
    base = TaskContext.get().partitionId() << 40
    for (*pair, ids, side, uses), _, _ in _whole_groups(batches, keys):
        new = _heads(*pair)
        group = np.cumsum(new) - 1
        keep = (np.add.reduceat(uses, np.flatnonzero(new)) > 1)[group]
        columns = [ids[keep], side[keep].astype(np.int32), base + group[keep], uses[keep]]
        base += int(group[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=exchange.arrow_schema(RANKED))


def _sorted_ranks(pairs: DataFrame, *pair: str) -> DataFrame:
    rows = pairs.select(*pair, "id", "side", "uses").repartitionByRange(*pair).sortWithinPartitions(*pair)
    return rows.mapInArrow(lambda batches: _rerank(batches, len(pair)), RANKED)


def _judge(batches):
    """Sorted (rank, content, id, n, periodic) -> JUDGED: contents that repeat entirely and those that show their starts."""
    for (rank, content, ids, n, periodic), first, last in _whole_groups(batches, 1):
        new_rank = _heads(rank)
        new = new_rank | _heads(content)
        head_rank, head, of_rank, of = np.flatnonzero(new_rank), np.flatnonzero(new), np.cumsum(new_rank) - 1, np.cumsum(new) - 1
        doubtful = (np.add.reduceat(new.astype(np.int64), head_rank) > 1) | np.logical_or.reduceat(periodic, head_rank)
        if first:
            doubtful[0] = True
        if last:
            doubtful[-1] = True
        flags = (np.add.reduceat(n, head) > 1)[of] * RESOLVED + (doubtful[of_rank] & new) * SUPPLIES
        told = flags > 0
        columns = [(ids[told] >> 32).astype(np.int32), content[told], flags[told].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=exchange.arrow_schema(JUDGED))


def judged_runs(blocks: DataFrame, threshold: int) -> DataFrame:
    """JUDGED rows of all blocks, by two rounds of doubling and one sort of contents."""
    spark = blocks.sparkSession
    paths = [new_path(spark, name) for name in ("runs", "first-ranks", "pairs", "ranks", "contents", "judged")]
    runs = written(blocks.groupBy("block").applyInArrow(exchange.one_argument(lambda b: _runs(b, threshold)), RUNS), paths[0])
    nodes = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"p{i}").alias("pair")) for i in range(2)])
    ranked = written(_sorted_ranks(runs.where("uses > 0").select("id", "uses", F.inline(nodes)), "pair"), paths[1])
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("rank")))
    pairs = ranked.groupBy("id").agg(side(0).alias("one"), side(1).alias("two"), F.max("uses").alias("uses")).where("one is not null and two is not null")
    alive = written(_sorted_ranks(written(pairs.withColumn("side", F.lit(0)), paths[2]), "one", "two"), paths[3])
    rows = written(runs.select("id", "content", "n", "periodic").join(alive.select("id", "rank"), "id").select("rank", "content", "id", "n", "periodic"), paths[4])
    judged = written(rows.repartitionByRange("rank", "content").sortWithinPartitions("rank", "content").mapInArrow(_judge, JUDGED), paths[5])
    remove(spark, *paths[:5])
    return judged


def _told(judged: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Contents of a block, sorted, and their flags."""
    content = judged["content"].to_numpy().view(np.uint64)
    order = np.argsort(content)
    return content[order], judged["flags"].to_numpy()[order].astype(np.uint8)


def _send_pairs(block: pa.Table, judged: pa.Table, ranges: int, threshold: int) -> pa.Table:
    if not block.num_rows:
        return exchange.to_table([], exchange.SENT)
    number = block["block"][0].as_py()
    content, flags = _told(judged)
    keys, owns, done = [], [], np.empty(0, dtype=np.uint64)
    for _, _, _, ranks in _batches(block, threshold):
        told = exchange.look_up(content, flags, ranks.content, 0)
        supplies = np.flatnonzero(told & SUPPLIES)
        fresh, at = np.unique(ranks.content[supplies], return_index=True)  # one copy of a content speaks for all
        fresh_at = at[~np.isin(fresh, done)]
        done = np.union1d(done, fresh)
        _, key, own = ranks.pairs(supplies[fresh_at])
        keys.append(key)
        owns.append(own)
    key, own = np.concatenate(keys), np.concatenate(owns)
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    head = np.flatnonzero(_heads(key, own)) if len(key) else np.empty(0, dtype=np.int64)
    rows = exchange.send(number, key[head], np.diff(np.append(head, len(key))), ranges, 64, own[head]) if len(key) else []
    if len(content):
        rows.append(exchange.hand_through(number, content, flags, ranges))
    return exchange.to_table(rows, exchange.SENT)


def _resolve_pairs(entries: list[exchange.Entry]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The pairs that stand at two starts, as key and first rank."""
    blocks, keys, count = exchange.join_entries(entries)
    if not len(keys):
        return []
    own = np.concatenate([np.frombuffer(e[3], dtype=np.uint64) for e in entries])
    order = np.lexsort((own, keys))
    blocks, keys, own, count = blocks[order], keys[order], own[order], count[order]
    new = _heads(keys, own)
    twice = (np.add.reduceat(count, np.flatnonzero(new)) > 1)[np.cumsum(new) - 1]
    return exchange.split_by_block(blocks[twice], keys[twice], own[twice])


def repeated_starts(ranks: Ranks, content: np.ndarray, flags: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the threshold-long string that starts at each position of the batch repeats."""
    out = np.zeros(len(ranks.data) + 1, dtype=bool)
    if not len(ranks.first):
        return out
    told = exchange.look_up(content, flags, ranks.content, 0)
    whole = np.flatnonzero(told & RESOLVED)
    size = ranks.stop[whole] - ranks.first[whole]
    out[np.repeat(ranks.first[whole] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = True
    starts, keys, own = ranks.pairs(np.flatnonzero(told == SUPPLIES))
    if len(pairs):
        at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        out[starts[(pairs[at] == keys) & (first[at] == own)]] = True
    return out


def covered(starts: np.ndarray, threshold: int) -> np.ndarray:
    """Bytes within threshold after a marked start."""
    n = len(starts) - 1
    out = np.empty(n, dtype=bool)
    for at in range(0, n, STRETCH):
        lo, stop = max(0, at - threshold + 1), min(n, at + STRETCH)
        seen = np.concatenate([[0], np.cumsum(starts[lo:stop], dtype=np.int64)])
        own = np.arange(at, stop)
        out[at:stop] = seen[own - lo + 1] > seen[np.maximum(own - threshold + 1, lo) - lo]
    return out


def _apply(block: pa.Table, answers: pa.Table, threshold: int, emit, ddl: str, keep: Sequence[str]) -> pa.Table:
    content, flags = exchange.received(answers, 0, np.uint8)
    pairs, first = exchange.received(answers, 1, np.uint64)
    ids, texts, rows = block["doc_id"].to_pylist(), exchange.block_texts(block), []
    for lo, hi, at, ranks in _batches(block, threshold):
        starts = repeated_starts(ranks, content, flags, pairs, first)
        if at is None:
            gone = covered(starts, threshold)
            for doc_id, text, a, b in zip(ids[lo:hi], texts[lo:hi], ranks.starts.tolist(), ranks.ends.tolist(), strict=True):
                rows.append(emit(doc_id, text, gone[a:b], ranks.data[a:b]))
            continue
        if at == 0:
            marked = np.zeros(len(texts[lo]) + 1, dtype=bool)
        own = marked[at : at + STRETCH]
        own |= starts[: len(own)]
        if at + STRETCH > len(texts[lo]) - threshold:
            rows.append(emit(ids[lo], texts[lo], covered(marked, threshold), np.frombuffer(texts[lo], dtype=np.uint8)))
    out = exchange.to_table(rows, ddl)
    for name in keep:
        out = out.append_column(name, block[name])
    return out


def _digest(doc_id, text: bytes, gone: np.ndarray, data: np.ndarray) -> tuple:
    removed = int(gone.sum())
    spans = int((gone[1:] & ~gone[:-1]).sum()) + bool(len(gone) and gone[0])
    kept = data[~gone].tobytes() if removed else text
    return doc_id, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")


def _kept_text(doc_id, text: bytes, gone: np.ndarray, data: np.ndarray) -> tuple:
    kept = data[~gone].tobytes() if gone.any() else text
    return doc_id, int(gone.sum()), kept.decode("utf-8", "ignore")


def _chain(documents: DataFrame, threshold: int, emit, ddl: str, keep: Sequence[str] = ()) -> DataFrame:
    blocks, n = exchange.blocked(documents, keep=keep)
    judged = judged_runs(blocks.select("doc_id", "text", "block"), threshold)

    def meet(answers: DataFrame, f, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(exchange.two_arguments(f), schema)

    pairs = meet(judged, lambda b, a: _send_pairs(b, a, n, threshold), exchange.SENT)
    about_pairs = exchange.reduce_ranges(pairs, n, _resolve_pairs)
    kept = [f"{name} {documents.schema[name].dataType.simpleString()}" for name in keep]
    return meet(about_pairs, lambda b, a: _apply(b, a, threshold, emit, ddl, keep), ", ".join([ddl, *kept]))


def removal_digests(documents: DataFrame, threshold: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the text that is left, without characters cut in two."""
    return _chain(documents, threshold, _digest, OUT)


def without_repeats(documents: DataFrame, threshold: int = 400, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_removed, the text that is left and the columns to keep; bytes of a character cut in two go with it."""
    return _chain(documents, threshold, _kept_text, "doc_id long, n_removed long, text string", keep)
