"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive lower-cased words between white space (a shorter text is one shingle). A shingle weighs
tf * idf with idf = 1 + ln(N / df) / ln(N), df counted over every document. A text's samples are drawn with
probability in proportion to weight, so two texts share a sample with the probability of their weighted Jaccard
similarity; samples are banded, and texts that share a band are compared exactly. Texts linked by a similarity of
``threshold`` or more, directly or through others, form a class.

Weights can only be shared where df > 1, so a text whose shared shingles weigh less than the threshold's part of it
has no near copy; it is set aside exactly, before any sampling. Equal texts meet by their hash and are compared once.

In a bucket of more than SURE texts, a text is compared with the bucket's least text and with its neighbours in the order of
other samples. Then every text outside its bucket's largest class meets all others of the bucket, until links have joined
their classes, but for pairs whose samples agree so seldom (five standard deviations below what the threshold lets expect)
that a pair at the threshold is so unlike itself in about two of a million cases, and more similar ones less often. Work is
about linear in a bucket whose texts are alike. Buckets are sorted over ranges that may cut one; they hold keys and samples, and shingles only join the pairs to
compare and the chunks of buckets that stay mixed.

Shingles are told apart by 48 bits, texts by 64. A chance equality of shingles moves a similarity or a count by one
shingle; one of texts, of which a trillion texts expect about 0.03, makes them one. A text is read in stretches; what is held
of it are some ten numbers a word, about 10 bytes a byte.

Defined results: null text counts as empty; texts without words are copies of each other; equal texts share a class;
a class is named by its smallest doc_id; rows with a null doc_id take part like any other, and a class of none but such rows
has a null class_id; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import exchange
from gleaner.llm.bytetools import groups_of, mix, pack_sorted, unpack_sorted, word_hashes, word_spans
from gleaner.llm.common import cut, new_path, remove, written
from gleaner.llm.components import components

BITS = 48
BANDS, ROWS = 12, 3
BATCH = 1 << 19
#: In buckets of up to so many texts all pairs are compared; in larger ones each text with so many less one neighbours.
SURE = 3
CHUNK, CHUNK_BYTES = 64, 1 << 20
TABLE = 1 << 16
SKETCH = "block int, doc_id long, key long, candidate boolean, bands binary, samples binary, shingles binary, weights binary"
LINK = "a long, b long, similarity double"


def _text_keys(word: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A key of the words of each text, in their order."""
    each = (np.arange(len(word)) - first[owner]).astype(np.uint64)
    each *= np.uint64(0xD6E8FEB86659FD93)
    each += word
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(each), dtype=np.uint64)])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def shingles_of(texts: list[bytes], n_words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, 48-bit shingle and count of each distinct shingle of each text, sorted; and a key of each text's words."""
    texts = [t.decode("utf-8", "replace").lower().encode("utf-8") for t in texts]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    starts, ends = word_spans(data)
    word = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)]))
    words = np.diff(first)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), words)
    key = _text_keys(word, first, owner)
    h = np.zeros(max(0, len(word) - n_words + 1), dtype=np.uint64)
    for j in range(n_words):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + word[j : j + len(h)])
    inside = owner[: len(h)] == owner[n_words - 1 :] if len(h) else np.zeros(0, dtype=bool)
    short = np.flatnonzero((words > 0) & (words < n_words))
    value = np.concatenate([h[inside], key[short]]) >> np.uint64(64 - BITS)
    of = np.concatenate([owner[: len(h)][inside], short.astype(np.int32)])
    del h, inside, word, owner, starts, ends
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])])) if len(of) else np.empty(0, dtype=np.int64)
    return of[new], value[new], np.diff(np.append(new, len(of))), key


def _batches(block: pa.Table):
    texts = exchange.block_texts(block)
    for lo, hi in groups_of(map(len, texts), BATCH):
        yield lo, hi, *shingles_of(texts[lo:hi])


def _send_counts(block: pa.Table, ranges: int) -> pa.Table:
    values = [value for _, _, _, value, _, _ in _batches(block)]
    found, df = np.unique(np.concatenate(values), return_counts=True) if values else (np.empty(0), None)
    if not len(found):
        return exchange.to_table([], exchange.SENT)
    return exchange.to_table(exchange.send(block["block"][0].as_py(), found, df, ranges, BITS, df.astype("<u4")), exchange.SENT)


def _resolve_counts(entries: list[exchange.Entry]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Document counts of the shingles that more than one document has."""
    blocks, keys, _ = exchange.join_entries(entries)
    if not len(keys):
        return []
    count = np.concatenate([np.frombuffer(e[3], dtype="<u4") for e in entries]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    blocks, keys, count = blocks[order], keys[order], count[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    df = np.add.reduceat(count, np.flatnonzero(new))[np.cumsum(new) - 1]
    shared = df > 1
    return exchange.split_by_block(blocks[shared], keys[shared], df[shared].astype("<u8"))


class Sampler:
    """Consistent weighted samples: for each of k draws, r and c from Gamma(2, 1) and b from [0, 1) by shingle.

    The draws come from tables of TABLE entries, picked by a hash of shingle and draw.
    """

    def __init__(self, draws: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.draws = draws
        self.r = rng.gamma(2.0, 1.0, TABLE).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, TABLE)).astype(np.float32)
        self.b = rng.random(TABLE).astype(np.float32)
        self.odd = rng.integers(1 << 62, size=(draws, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, shingle: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Samples [texts, draws] as 32-bit numbers; first is where each text's (non-empty) run of shingles starts."""
        out = np.empty((len(first), self.draws), dtype=np.uint32)
        log_w = np.log(weight).astype(np.float32)
        size = np.diff(np.append(first, len(shingle)))
        shift = np.uint64(48)
        for k in range(self.draws):
            at = [((shingle * self.odd[k, j]) >> shift).astype(np.intp) for j in range(3)]
            r, b = self.r[at[0]], self.b[at[2]]
            t = np.floor(log_w / r + b)
            a = self.log_c[at[1]] - r * (t - b) - r
            best = np.repeat(np.minimum.reduceat(a, first), size)
            hit = np.flatnonzero(a == best)
            hit = hit[np.searchsorted(hit, first)]
            out[:, k] = mix(shingle[hit] * np.uint64(31) + t[hit].astype(np.int64).astype(np.uint64)) >> np.uint64(32)
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, [texts, BANDS]."""
    out = np.empty((len(samples), BANDS), dtype=np.int64)
    for band in range(BANDS):
        h = np.full(len(samples), band, dtype=np.uint64)
        for j in range(ROWS):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + samples[:, band * ROWS + j].astype(np.uint64) + np.uint64(1))
        out[:, band] = h.view(np.int64)
    return out


def _sketch(block: pa.Table, answers: pa.Table, n_docs: int, threshold: float) -> pa.Table:
    """Rows of SKETCH. The first of equal texts of a block carries its sketch."""
    shared, df = exchange.received(answers, 1, np.dtype("<u8"))
    ids, rows, seen, sampler = block["doc_id"].to_pylist(), [], set(), Sampler(BANDS * ROWS)
    number = block["block"][0].as_py() if block.num_rows else None
    for lo, _, of, shingle, tf, key in _batches(block):
        key = key.view(np.int64).tolist()
        n = len(key)
        count = exchange.look_up(shared, df, shingle, 1).astype(np.float64)
        weight = tf * (1.0 + np.log(n_docs / count) / np.log(max(n_docs, 2)))
        total = np.bincount(of, weights=weight, minlength=n)
        common = np.bincount(of, weights=weight * (count > 1), minlength=n)
        candidate = (common >= threshold * total - 1e-6) | (total == 0)
        pick = np.zeros(n, dtype=bool)
        for i in np.flatnonzero(candidate & (total > 0)).tolist():
            if key[i] not in seen:
                seen.add(key[i])
                pick[i] = True
        sketched: dict[int, tuple] = {}
        if pick.any():
            keep = pick[of]
            s, w, own = shingle[keep], weight[keep], of[keep]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            samples = sampler(s, w, first)
            bands, stop = band_keys(samples), np.append(first[1:], len(s))
            for j, i in enumerate(own[first].tolist()):
                a, b = first[j], stop[j]
                sketched[i] = (bands[j].tobytes(), samples[j].tobytes(), pack_sorted(s[a:b]), w[a:b].astype("<f4").tobytes())
        for i in range(n):
            rows.append((number, ids[lo + i], key[i], bool(candidate[i]), *sketched.get(i, (None,) * 4)))
    return exchange.to_table(rows, SKETCH)


def _to_longs(batches):
    """key, samples, bands -> a row a band with the samples of the next two bands, round to its own."""
    for batch in batches:
        keys, samples, blobs = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for key, own, blob in zip(keys, samples, blobs, strict=True):
            for i, band in enumerate(np.frombuffer(blob, dtype=np.int64).tolist()):
                turn = 4 * ROWS * (i + 1) % len(own)
                rows.append((key, band, (own[turn:] + own[:turn])[: 8 * ROWS]))
        yield from exchange.to_table(rows, "key long, band long, others binary").to_batches()


def _neighbours(batches):
    """Pairs of each text and the SURE - 1 before it in its band; rows come sorted."""
    keys, bands = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for batch in batches:
        old = len(keys)
        keys, bands = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((keys, bands)))
        found = []
        for step in range(1, SURE):
            later = np.arange(max(old, step), len(keys))
            later = later[bands[later] == bands[later - step]]
            found.append((np.minimum(keys[later], keys[later - step]), np.maximum(keys[later], keys[later - step])))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*found, strict=True)], names=["a", "b"])
        keys, bands = keys[1 - SURE :], bands[1 - SURE :]


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum())
    return both / max(float(wa.sum()) + float(wb.sum()) - both, 1e-12)


def _verified(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b) of keys whose texts are at least threshold similar, with the similarity."""

    def run(batches):
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                a, b, sa, wa, sb, wb = (column[row].as_py() for column in batch.columns)
                j = weighted_jaccard(unpack_sorted(sa), np.frombuffer(wa, "<f4"), unpack_sorted(sb), np.frombuffer(wb, "<f4"))
                if j >= threshold - 1e-6:
                    found.append((a, b, j))
            yield from exchange.to_table(found, LINK).to_batches()

    side = lambda x: sketches.select(F.col("key").alias(x), F.col("shingles").alias(f"s{x}"), F.col("weights").alias(f"w{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "wa", "sb", "wb")
    return both.mapInArrow(run, LINK)


def linked_texts(sketches: DataFrame, threshold: float) -> DataFrame:
    """(id, component) of the keys of distinct texts that links join into classes."""
    members = cut(sketches.select("key", "samples", "bands").mapInArrow(_to_longs, "key long, band long, others binary"))
    about = (F.count(F.lit(1)).alias("n"), F.min("key").alias("lead"), F.max("key").alias("last"), F.bit_xor("key").alias("odd"))
    crowded = cut(members.groupBy("band").agg(*about).where("n > 1"))
    # Of up to three texts, least, greatest and exclusive or give all.
    third = F.col("lead").bitwiseXOR(F.col("last")).bitwiseXOR(F.col("odd"))
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    each = F.when(F.col("n") == 2, F.array(pair("lead", "last"))).otherwise(F.array(pair("lead", "last"), pair("lead", "third"), pair("third", "last")))
    few = crowded.where(F.col("n") <= SURE).withColumn("third", third).select(F.inline(each))
    large = cut(members.join(crowded.where(F.col("n") > SURE).select("band", "lead"), "band"))
    leads = large.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    ordered = large.repartitionByRange("band", "others", "key").sortWithinPartitions("band", "others", "key")
    near = ordered.select("key", "band").mapInArrow(_neighbours, "a long, b long")
    pairs = few.unionByName(leads).unionByName(near).distinct()
    found = components(_verified(pairs, sketches, threshold))
    more = _across(large.select("band", "key"), sketches, found, threshold)
    if more is None:
        return found
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")))


def _across(members: DataFrame, sketches: DataFrame, found: DataFrame, threshold: float) -> DataFrame | None:
    """Links between texts of one bucket that found leaves in different classes; None if there are no such texts.

    Every text outside its bucket's largest class meets every other text of the bucket, in chunks of about CHUNK texts and
    CHUNK_BYTES. A pair is compared if its samples agree often enough, in the first of its buckets, and if no link found
    in the chunk has yet joined its classes; what most agree come first.
    """
    placed = cut(members.join(found.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    mixed = placed.groupBy("band").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("band")
    placed = cut(placed.join(mixed, "band"))
    if placed.isEmpty():
        return None
    sizes = placed.join(sketches.select("key", F.octet_length("shingles").alias("size")), "key")
    sizes = sizes.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes"))
    chunks = F.greatest(F.lit(1), F.ceil(F.sum("m") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("long").alias("chunks")
    buckets = cut(sizes.groupBy("band").agg(F.max_by("component", F.struct("m", "component")).alias("main"), chunks))
    text = F.struct("key", "component", "bands", "samples", "shingles", "weights")
    chunk = F.pmod(F.xxhash64("key"), "chunks").alias("chunk")
    dealt = placed.join(buckets, "band").join(sketches, "key").select("band", chunk, (F.col("component") != F.col("main")).alias("apart"), text.alias("text"))
    every = dealt.groupBy("band", "chunk").agg(F.collect_list("text").alias("texts"))
    apart = dealt.where("apart").groupBy("band", "chunk").agg(F.collect_list("text").alias("apart"))
    met = apart.select("band", "apart").join(every.select("band", "texts"), "band")
    # Spark splits the join's large partitions; a Python start for each small split would cost more than its work.
    met = met.coalesce(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(met.mapInArrow(lambda batches: _meet(batches, threshold), LINK))


def _meet(batches, threshold: float):
    draws = BANDS * ROWS
    least = draws * threshold - 5 * (draws * threshold * (1 - threshold)) ** 0.5
    for batch in batches:
        found = []
        for row in range(batch.num_rows):
            band, left, right = (column[row].as_py() for column in batch.columns)
            sides = [
                [np.stack([np.frombuffer(t[name], kind) for t in side]) for name, kind in (("samples", np.uint32), ("bands", np.int64))] for side in (left, right)
            ]
            agree = (sides[0][0][:, None] == sides[1][0][None]).sum(axis=2)
            first = (sides[0][1][:, None] == sides[1][1][None]).argmax(axis=2)
            here = np.take_along_axis(sides[0][1], first, axis=1) == band
            i, j = np.nonzero((agree >= least) & here)
            root: dict[int, int] = {}

            def top(x: int, root: dict[int, int] = root) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for k in np.argsort(-agree[i, j], kind="stable").tolist():
                x, y = left[i[k]], right[j[k]]
                cx, cy = top(x["component"]), top(y["component"])
                if cx == cy:
                    continue
                s = weighted_jaccard(*(f(t) for t in (x, y) for f in (lambda t: unpack_sorted(t["shingles"]), lambda t: np.frombuffer(t["weights"], "<f4"))))
                if s >= threshold - 1e-6:
                    found.append((min(x["key"], y["key"]), max(x["key"], y["key"]), s))
                    root[cx] = cy
        yield from exchange.to_table(found, LINK).to_batches()


def near_duplicate_classes(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), class_size."""
    spark = documents.sparkSession
    blocks, n = exchange.blocked(documents)
    n_docs = max(1, documents.select("doc_id").count())
    counts = blocks.groupBy("block").applyInArrow(exchange.one_argument(lambda b: _send_counts(b, n)), exchange.SENT)
    about = exchange.reduce_ranges(counts, n, _resolve_counts)
    sketch = exchange.two_arguments(lambda b, a: _sketch(b, a, n_docs, threshold))
    paths = [new_path(spark, name) for name in ("sketches", "picked", "keys")]
    rows = written(blocks.groupBy("block").cogroup(about.groupBy("block")).applyInArrow(sketch, SKETCH), paths[0])
    one = rows.where(F.col("shingles").isNotNull()).groupBy("key").agg(F.min("block").alias("block"))
    sketches = rows.where(F.col("shingles").isNotNull()).join(one, ["key", "block"]).select("key", "bands", "samples", "shingles", "weights")
    sketches = written(sketches, paths[1])
    rows = written(rows.select("doc_id", "key", "candidate"), paths[2])
    texts = rows.where("candidate").select("doc_id", "key")
    found = linked_texts(sketches, threshold)
    remove(spark, *paths[:2])
    named = texts.join(found.withColumnRenamed("id", "key"), "key", "left")
    named = cut(named.select("doc_id", F.coalesce("component", "key").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    named = named.join(least, "component").select("doc_id", "class_id", "class_size")
    alone = rows.where(~F.col("candidate")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return named.unionByName(alone)
