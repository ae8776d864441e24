"""LM scoring: the marginal probability of a text over all its segmentations.

A text is a row of lower-cased (A-Z) words between white space and one end. Its lattice has two kinds of arcs. Pieces of an
existing vocabulary spell a word; the vocabulary's own scores weight all segmentations, moved towards the corpus by one
pass of expected uses over the distinct training words (the scores count as ``prior_uses`` uses beside them). A whole
training word also has an arc of its own, weighted by its count c over all training texts. With N training tokens, V
distinct ones and the discount d = n1 / (n1 + 2 n2) from the words seen once and twice,

    log p(word) = logadd( log((c - d) / N), log(d V / N) + log sum over segmentations )

where no path leaves log space, so no text is too long or too odd for a finite score. No segmentation crosses white space,
so the forward recursion over a text is the sum over its words, and each distinct word of the corpus is spelled once.

Every block of texts gives its distinct words and counts; Spark sums them by word, spells them, and joins them back. Within
a block words are told apart by 64 bits, between blocks as they are. Neither words nor counts are gathered anywhere: the
driver gets five totals and one number for each piece of the vocabulary.

The share d V / N of all probability is the lattice's own; training words have the rest besides. A count-based base without
that share gives more on texts all of whose words are known, by log10(1 - d V / N) a token, and gives unseen words what no
model of all strings can, so it is no measure of this one.

Defined results: null text counts as empty (its score is the end's); equal texts score alike; a null doc_id is never
held out; without training texts counts are zero; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import exchange
from gleaner.llm.bytetools import groups_of, word_hashes, word_spans
from gleaner.llm.common import new_path, written
from gleaner.llm.lattice import PIECES, Lattice, read_pieces, reestimated

BATCH, LEAST_BLOCK = 1 << 20, 16 << 20
WORDS = "block int, word binary, place int, n long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Fold:
    """Held out: crc32 of the doc_id as text leaves this remainder."""

    modulus: int = 7
    remainder: int = 2

    def held_out(self, ids: list) -> np.ndarray:
        return np.array([i is not None and zlib.crc32(str(i).encode()) % self.modulus == self.remainder for i in ids], dtype=bool)


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct tokens, words seen once and twice, and ends."""

    tokens: int
    distinct: int
    once: int
    twice: int
    ends: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once else 0.001

    def log_word(self, count: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Natural-log probability of words with these training counts and log-probabilities of their spellings."""
        if not self.tokens:
            return spelled
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(count - self.discount, 0.0) / self.tokens)
        return np.logaddexp(whole, math.log(self.discount * self.distinct / self.tokens) + spelled)


class Words:
    """The distinct words of a block and the words of each text as places among them."""

    def __init__(self, block: pa.Table):
        texts = exchange.block_texts(block)
        keys, names, uses, sizes = [], [], [], []
        for lo, hi in groups_of(map(len, texts), BATCH):
            lowered = [t.lower() for t in texts[lo:hi]]
            raw = b" ".join([*lowered, b""])
            data = np.frombuffer(raw, dtype=np.uint8)
            starts, ends = word_spans(data)
            key, example, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            keys.append(key)
            names += [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
            uses.append(key[which])
            first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in lowered)]))
            sizes.append(np.diff(first))
        every = np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)
        keys, example = np.unique(every, return_index=True)
        self.names = [names[i] for i in example.tolist()]
        self.sizes = np.concatenate(sizes) if sizes else np.empty(0, dtype=np.int64)
        self.uses = np.searchsorted(keys, np.concatenate(uses)) if uses else np.empty(0, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)


def _counted(block: pa.Table, fold: Fold) -> pa.Table:
    """The distinct words of a block with their training counts (0 where only held-out texts have them)."""
    words = Words(block)
    train = ~fold.held_out(block["doc_id"].to_pylist())
    count = np.bincount(words.uses[train[words.owner]], minlength=len(words.names)) if len(words.names) else np.empty(0)
    n = len(words.names)
    number = block["block"][0].as_py() if n else 0
    columns = [np.full(n, number, dtype=np.int32), pa.array(words.names, pa.binary()), np.arange(n, dtype=np.int32), count.astype(np.int64)]
    return pa.table([pa.array(c) for c in columns], schema=exchange.arrow_schema(WORDS))


def adjusted(words: DataFrame, pieces: list, log_p: np.ndarray, prior_uses: float) -> np.ndarray:
    """Log probabilities of the pieces after one pass over words(word), each counted once; unseen words resemble types more than tokens."""

    def run(batches):
        lattice, expected = Lattice(pieces, log_p), np.zeros(len(pieces))
        for batch in batches:
            names = batch.column(0).to_pylist()
            expected += lattice.expected_counts(names, np.ones(len(names)))
        some = np.flatnonzero(expected)
        yield from exchange.to_table(list(zip(some.tolist(), expected[some].tolist(), strict=True)), "piece long, used double").to_batches()

    used = np.zeros(len(pieces))
    for row in words.mapInArrow(run, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect():
        used[row["piece"]] = row["used"]
    return reestimated(log_p, used, prior_uses)


def gathered(vocabulary: DataFrame, documents: DataFrame, fold: Fold) -> Totals:
    """Totals; the driver gets five numbers."""
    seen = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))
    n = F.col("n")
    sums = vocabulary.agg(F.coalesce(F.sum(n), F.lit(0)), seen(n > 0), seen(n == 1), seen(n == 2)).first()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold.modulus == fold.remainder, F.lit(False))
    ends = documents.where(~held_out).count()
    return Totals(sums[0] + ends, sums[1] + bool(ends), sums[2], sums[3], ends)


def _spelled(vocabulary: DataFrame, pieces: list, log_p: np.ndarray, totals: Totals) -> DataFrame:
    """word, n, log_p of every distinct word of the corpus."""

    def run(batches):
        lattice = Lattice(pieces, log_p)
        for batch in batches:
            spelled = totals.log_word(batch.column(1).to_numpy().astype(np.float64), lattice.log_likelihood(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spelled, pa.float64())], names=["word", "n", "log_p"])

    return vocabulary.mapInArrow(run, "word binary, n long, log_p double")


def _score(block: pa.Table, known: pa.Table, fold: Fold, totals: Totals) -> pa.Table:
    if not block.num_rows:
        return exchange.to_table([], SCORED)
    words, ids = Words(block), block["doc_id"].to_pylist()
    place = known["place"].to_numpy()
    count, log_p = np.zeros(len(words.names)), np.zeros(len(words.names))
    count[place], log_p[place] = known["n"].to_numpy(), known["log_p"].to_numpy()
    n, v = totals.tokens, totals.distinct
    base = np.log10((count + 1) / (n + v + 1))
    end = math.log10((totals.ends + 1) / (n + v + 1))
    add = lambda x: np.bincount(words.owner, weights=x[words.uses], minlength=len(ids)) if len(words.uses) else np.zeros(len(ids))
    columns = (
        ids,
        fold.held_out(ids).tolist(),
        (words.sizes + 1).tolist(),
        (add((count > 0).astype(np.float64)).astype(np.int64) + bool(totals.ends)).tolist(),
        [n] * len(ids),
        (add(base) + end).tolist(),
        (add(log_p / math.log(10)) + end).tolist(),
    )
    return exchange.to_table(list(zip(*columns, strict=True)), SCORED)


def score_texts(documents: DataFrame, fold: Fold = Fold(), vocabulary: str = PIECES, prior_uses: float | None = None) -> DataFrame:
    """SCORED rows of every document. prior_uses: one for each piece, if none are given."""
    spark = documents.sparkSession
    pieces, log_p = read_pieces(vocabulary)
    blocks, _ = exchange.blocked(documents, least=LEAST_BLOCK)
    words = written(blocks.groupBy("block").applyInArrow(exchange.one_argument(lambda b: _counted(b, fold)), WORDS), new_path(spark, "words"))
    distinct = written(words.groupBy("word").agg(F.sum("n").alias("n")), new_path(spark, "distinct"))
    totals = gathered(distinct, documents, fold)
    log_p = adjusted(distinct.where("n > 0").select("word"), pieces, log_p, len(pieces) if prior_uses is None else prior_uses)
    known = words.select("block", "place", "word").join(_spelled(distinct, pieces, log_p, totals), "word").select("block", "place", "n", "log_p")
    score = exchange.two_arguments(lambda b, k: _score(b, k, fold, totals))
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, SCORED)
