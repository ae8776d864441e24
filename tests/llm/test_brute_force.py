"""Operators that SQL cannot express, against brute force, held-out accuracy or exact round trips."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import ann, bytetools, langid, lattice, lmscore, neardup, packing, quality, suffixdedup, tokenfile, tokens
from gleaner.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_every_operator_is_registered():
    assert [sum(name.startswith(f"op{n}_") for name in queries()) for n in range(1, 11)] == [1] * 10
    assert set(oracle_sql()) <= set(queries())


def test_chat_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = {r[0]: r for r in c.execute(oracle_sql()["op1_chat_format"]).fetchall()}
    rows = queries()["op1_chat_format"](spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r) == want[r["conv_id"]]


def test_language_of_held_out_documents(spark):
    rows = queries()["op2_language_id"](spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = langid._init(["a", "b"], 3, rng)
    net.e = [e.astype(np.float64) for e in net.e]
    net.u = [u.astype(np.float64) for u in net.u]
    net.v = net.v.astype(np.float64)
    x, y = rng.integers(1, 6, (2, 5)).astype(np.uint8), np.array([0, 1])

    def loss():
        both = np.concatenate([langid._run(net, k, x)[0].astype(np.float64) for k in range(2)], axis=2)
        p = langid._softmax(both @ net.v + net.c)
        return -np.log(p[:, np.arange(2), y]).mean()

    grads = langid._gradients(net, x, y)
    for p, g in ((net.v, grads[4]), (net.u[0], grads[2]), (net.e[1], grads[1])):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = p[at], 1e-2
        p[at] = kept + step
        up = loss()
        p[at] = kept - step
        down = loss()
        p[at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


ODD = ["", "  ", "don't we'll 'S <|endoftext|>x", "é ́a ﬁ Ⅷ x²", "\x1c\x1d a　d", "ß ẞ İstanbul ΑΣ", "a\x00b", "😀👍🏽 日本語", "≠ ≮ ≠", "Of%%% the&&& a,b;c. x!!"]


def test_chunked_tokens_equal_whole_ones(texts):
    own = tokens.ChunkTokenizer(tokens.vocabulary_path(tokens.WORD_BPE), store_limit=500)
    given = [*texts.values(), *ODD]
    for text, ids in zip(given, own.encode([t.encode() for t in given]), strict=True):
        assert ids.tolist() == own.full.encode(text, add_special_tokens=False).ids


def test_packing_of_documents(spark, texts):
    full = tokens.tokenizer(tokens.WORD_BPE).full
    rows = queries()["op3_pack"](spark, SF).collect()
    by, fill = defaultdict(list), Counter()
    for r in rows:
        by[r["doc_id"]].append(r)
        fill[r["sequence_id"]] += r["length"]
    for i, text in texts.items():
        ids = np.array([*full.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in pieces] == [(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    assert max(fill.values()) <= 4096
    bound = packing.lower_bound(Counter(r["length"] for r in rows), 4096)
    assert bound <= len(fill) <= bound + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7), st.just(20))
def test_bounds_never_exceed_the_best_packing(lengths, capacity):
    best = len(lengths)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j, fill in enumerate(bins):
            if fill + lengths[i] <= capacity:
                place(i + 1, [*bins[:j], fill + lengths[i], *bins[j + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    assert packing.lower_bound(Counter(lengths), capacity) <= best
    _, _, fills = packing.best_fit(np.array(sorted(lengths, reverse=True)), capacity)
    assert best <= len(fills) and fills.sum() == sum(lengths)


def repeated(texts: list[bytes], n: int) -> list[np.ndarray]:
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("threshold", [8, 40, 400])
def test_repeats(spark, texts, threshold):
    given = {i: t for i, t in texts.items() if threshold == 400 or i < 60} | {1000: "ab" * 300, 1001: "a" * 900, 1002: "ab" * 100}
    table = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    raw = {i: t.encode() for i, t in given.items()}
    for r, gone in zip(sorted(suffixdedup.removal_digests(table, threshold).collect(), key=lambda r: r["doc_id"]), repeated([raw[i] for i in sorted(raw)], threshold), strict=True):
        data = np.frombuffer(raw[r["doc_id"]], np.uint8)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), gone.sum(), spans)
        assert r["kept_sha256"] == hashlib.sha256(data[~gone].tobytes()).hexdigest()


def test_token_file(spark, texts):
    full = tokens.tokenizer(tokens.WORD_BPE).full
    rows = {r["doc_id"]: r for r in queries()["op5_token_file"](spark, SF).collect()}
    at = 0
    for i in sorted(texts):
        ids = np.array([*full.encode(texts[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_frames_read_one_by_one():
    writer = tokenfile.SegmentWriter(b"")
    given = [np.arange(n, dtype=np.uint32) * 70 for n in (0, 1, 5000)]
    for i, ids in enumerate(given):
        writer.add(i if i else None, ids)
    n, data = writer.take()
    reader = tokenfile.SegmentReader(data, b"")
    assert n == 5001 and reader.null.tolist() == [True, False, False]
    assert all((reader.ids(i) == ids).all() for i, ids in enumerate(given))


def test_nearest_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = defaultdict(dict)
    for r in queries()["op6_ann_search"](spark, SF).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        own = found[ids[i]]
        assert sorted(own) == list(range(1, 21))
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-9 for v, s in own.values())
        hits += len({v for v, _ in own.values()} & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits / (20 * len(found)) >= 0.9


def test_anisotropic_codes_keep_products_better():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 32))
    coder = ann.train(x)
    plain = ann.Quantiser(coder.books, 1.0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(codes):
        back = coder.books[np.arange(coder.books.shape[0]), codes].reshape(len(x), -1)[:, :32]
        return (((x - back) * unit).sum(axis=1) ** 2).mean()

    assert parallel(coder.encode(x)) < parallel(plain.encode(x))


def test_near_duplicate_classes(spark, texts):
    shingles = {}
    for i, t in texts.items():
        w = t.lower().split()
        shingles[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    df = Counter(s for c in shingles.values() for s in c)
    n = len(texts)
    weight = {i: {s: k * (1 + math.log(n / df[s]) / math.log(n)) for s, k in c.items()} for i, c in shingles.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and (both := weight[a].keys() & weight[b].keys()):
                shared = sum(min(weight[a][s], weight[b][s]) for s in both)
                if shared / (sum(weight[a].values()) + sum(weight[b].values()) - shared) >= 0.8:
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    assert {r["doc_id"]: r["class_id"] for r in queries()["op7_minhash_dedup"](spark, SF).collect()} == {i: top(i) for i in texts}


def test_large_bucket_of_chained_copies(spark):
    """A chain of small edits is one class although its ends differ."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        words[:i] = [f"v{j}" for j in range(i)] if i < 120 else words[:i]
        rows.append((i, " ".join(words)))
    rows = rows[:100]
    found = neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in found} == {0}


def test_samples_estimate_similarity():
    rng = np.random.default_rng(2)
    shingle = np.sort(rng.integers(1 << 48, size=400, dtype=np.uint64))
    wa, wb = rng.uniform(0.5, 2, 400), rng.uniform(0.5, 2, 400)
    sampler = neardup.Sampler(600)
    a, b = (sampler(shingle, w, np.array([0]))[0] for w in (wa, wb))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - want) < 0.07


def test_lm_scores(spark, texts):
    """Every column against a plain computation with dictionaries and a recursion over each word."""
    rows = {r["doc_id"]: r for r in queries()["op8_lm_score"](spark, SF).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for i, t in texts.items():
        if not held(i):
            count.update([*t.encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    pieces, log_p = lattice.read_pieces()
    place = {p: k for k, p in enumerate(pieces)}
    longest = max(len(p) for p in pieces if isinstance(p, bytes))

    def arcs(word):
        x = lattice.MARK + word
        for end in range(3, len(x) + 1):
            for start in [0, *range(3, end)]:
                if end - start <= longest and (k := place.get(x[start:end])) is not None:
                    yield start, end, k
            if end > 3 and (k := place.get(x[end - 1])) is not None:
                yield end - 1, end, k

    def sums(word, log_p):
        alpha = {0: 0.0}
        for start, end, k in arcs(word):
            if start in alpha:
                alpha[end] = np.logaddexp(alpha.get(end, -np.inf), alpha[start] + log_p[k])
        return alpha

    used = np.zeros(len(pieces))
    for word in (w for w in count if w is not None):
        alpha, beta, size = sums(word, log_p), {len(word) + 3: 0.0}, len(word) + 3
        for start, end, k in sorted(arcs(word), key=lambda a: -a[0]):
            if start in alpha and end in beta:
                used[k] += math.exp(alpha[start] + log_p[k] + beta[end] - alpha[size])
                beta[start] = np.logaddexp(beta.get(start, -np.inf), log_p[k] + beta[end])
    prior = len(pieces) * np.exp(log_p) + used
    log_p = np.log(prior / prior.sum())
    ones, twos = (sum(c == k for w, c in count.items() if w is not None) for k in (1, 2))
    d = ones / (ones + 2 * twos)
    end = math.log10((count[None] + 1) / (n + v + 1))

    def scored(word):
        spelled = math.log(d * v / n) + sums(word, log_p)[len(word) + 3]
        return np.logaddexp(math.log(max(count[word] - d, 1e-300) / n), spelled) / math.log(10)

    for i, t in texts.items():
        words = t.encode().lower().split()
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words) + end
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(words) + 1, sum(count[w] > 0 for w in words) + 1, n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
        assert abs(r["score"] - sum(map(scored, words)) - end) < 1e-6 * abs(r["score"])


def test_marginals_sum_all_segmentations():
    pieces = ["▁a".encode(), "▁ab".encode(), b"b", b"bc", b"c", "▁".encode(), ord("a"), ord("b"), ord("c"), ord("z")]
    log_p = np.log(np.array([0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.1]))
    p = {(x if isinstance(x, bytes) else bytes([x]), isinstance(x, int)): math.exp(q) for x, q in zip(pieces, log_p, strict=True)}

    def total(rest: bytes, start: bool) -> float:
        if not rest:
            return 1.0
        return sum(q * total(rest[len(x) :], False) for (x, byte), q in p.items() if rest.startswith(x) and not (start and byte))

    model = lattice.Lattice(pieces, log_p)
    words = [b"abc", b"a", b"zz", b"", b"bcb"]
    assert all(abs(model._along(np.frombuffer(lattice.MARK + w, np.uint8))[-1] - model.log_likelihood([w])[0]) < 1e-12 for w in words)
    assert np.allclose(np.exp(model.log_likelihood(words)), [total(lattice.MARK + w, True) for w in words])


def test_expected_counts_add_up():
    pieces, log_p = lattice.read_pieces()
    model = lattice.Lattice(pieces, log_p)
    words = [b"walking", "éçqueê".encode(), b"the" * 40]
    times = np.array([1.0, 2.0, 3.0])
    used = model.expected_counts(words, times)
    length = np.array([1 if isinstance(p, int) else len(p) for p in pieces])
    assert abs((used * length).sum() - sum(t * (len(w) + 3) for w, t in zip(words, (1, 2, 3), strict=True))) < 1e-6
    better = lattice.Lattice(pieces, lattice.reestimated(log_p, used, prior_uses=1e-9))
    assert (times * better.log_likelihood(words)).sum() > (times * model.log_likelihood(words)).sum()


def test_quality_finds_planted_words():
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, grades = [], []
    for i in range(1200):
        words = rng.choice(vocabulary, 60).tolist()
        grade = i % 3
        if grade == 0:
            words[5] = "horrid"
        if grade == 1:
            words = [w + "###" for w in words]
        rows.append(" ".join(words).encode())
        grades.append(grade)
    ids, first = quality.featurise(rows[:900])
    model = quality.train(ids, first, np.array(grades[:900]), 3)
    tails = model.tails(model.scores(*quality.featurise(rows[900:])))
    assert np.mean((tails >= 0.5).sum(axis=1) == grades[900:]) > 0.9
    assert (np.diff(model.thresholds) > 0).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=50))
def test_packed_hashes_round_trip(values):
    values = np.array(sorted(values), dtype=np.uint64)
    assert (bytetools.unpack_sorted(bytetools.pack_sorted(values)) == values).all()


def test_fold_takes_crc_of_the_text_form():
    assert lmscore.Fold().held_out([5, None]).tolist() == [zlib.crc32(b"5") % 7 == 2, False]
